"""Language identification of web pages by fusion of evidence.

Text likelihoods come from letter trigrams of labelled documents, at most LABELLED rows of the smallest hashes of doc_id
(a documented bound), for every language in them.  The rest is learned from all pages by grouped aggregation of their text posteriors: how often each
declared markup language goes with each language, and how often a host, its domain, its address suffix and all pages
have each language.  A host's prior is its own counts, less the page's own, on top of its domain's, on top of its
suffix's, on top of those of all pages.  The posterior of a page is the product of the three.

Counts are summed before they are shuffled, so a host may have any share of the pages; hosts and counts stay on the
executors, and so do those of declared languages; only their sums reach the driver.  Null html has no text evidence, a null or odd url the empty host, a
page without declared language no such evidence; without labelled documents there is no language, and all pages get null.
Of languages with equal posteriors the first by name is taken.  Repeated rows count as pages of their own and get equal
results; a page of any length is read whole, in time proportional to it; no pages give no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common as c

#: Labelled documents read, buckets of trigrams, languages scored at a time, pages scored at a time if there are more languages.
LABELLED, BUCKETS, LANGUAGES, PAGES = 20_000, 1 << 15, 64, 256
Table = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Trigrams overlap, so a text counts as a third of its trigrams.
EACH = 1 / 3
#: Weight, in pages, of each level's prior from the level above it.
WEIGHT = 4.0

_OPEN = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*+>", re.I) for x in ("script", "style", "template", "noscript")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML, _META = re.compile(r"<html\b", re.I), re.compile(r"<meta\b", re.I)
_LANG = re.compile(r"""\s(?:xml:)?lang\s*+=\s*+["']?+\s*+([A-Za-z]{2,8})""", re.I)
_KIND = re.compile(r"""http-equiv\s*+=\s*+["']?+content-language|property\s*+=\s*+["']?+og:locale""", re.I)
_CONTENT = re.compile(r"""content\s*+=\s*+["']?+\s*+([A-Za-z]{2,8})""", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)")
_ADDRESS = re.compile(r"\[.*|\d{1,3}(?:\.\d{1,3}){3}")
# Labels below which names are registered, as in co.uk.
SECOND_LEVEL = frozenset("ac co com edu gob gouv gov ltd mil ne net nom or org plc sch".split())


def text_of(page: str) -> str:
    """The text outside of tags, comments and hidden elements, in time proportional to the page."""
    out, done, unclosed = [], 0, set()
    for m in _OPEN.finditer(page):
        kind = (m[1] or "").lower()
        if m.start() < done or kind in unclosed:
            continue
        end = _CLOSE[kind].search(page, m.end())
        if end is None:
            unclosed.add(kind)  # nor is there one further on
            continue
        out.append(page[done : m.start()])
        done = end.end()
    seen = " ".join([*out, page[done:]])
    # Behind the last > nothing is a tag, and up to it every < begins one.
    last = seen.rfind(">") + 1
    return entities.unescape(_TAG.sub(" ", seen[:last]) + seen[last:])


def _tags(begin: re.Pattern, page: str) -> Iterator[str]:
    """What stands in tags of that beginning, up to the next >."""
    done = 0
    for m in begin.finditer(page):
        if m.start() >= done:
            done = page.find(">", m.end())
            done = len(page) if done < 0 else done
            yield page[m.end() : done]


def declared(page: str) -> str | None:
    """The language of the html tag, or else of a meta tag, in time proportional to the page."""
    for tag in _tags(_HTML, page):
        if found := _LANG.search(tag):
            return found[1].lower()
    for tag in _tags(_META, page):
        if (kind := _KIND.search(tag)) and (found := _CONTENT.search(tag, kind.end())):
            return found[1].lower()
    return None


def host_of(url: str | None) -> tuple[str, str, str]:
    """(host, registered domain, suffix); an address has its own domain and no suffix."""
    m = _HOST.match(url or "")
    host = m[1].lower().strip(".") if m else ""
    if _ADDRESS.fullmatch(host):
        return host, host, ""
    parts = host.split(".")
    n = 3 if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in SECOND_LEVEL else 2
    return host, ".".join(parts[-n:]), parts[-1]


def trigrams(text: str) -> np.ndarray:
    """How often each bucket's trigrams of letters and word borders occur."""
    low = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    x = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(x) < 3:
        return np.zeros(BUCKETS)
    h = c.mix(x[:-2] | x[1:-1] << np.uint64(21) | x[2:] << np.uint64(42))
    return np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(float)


def _sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at, counts[at]


def _dense(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = np.zeros(BUCKETS)
    x[at] = n
    return x


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the buckets that occur, for each batch and language."""
    for b in batches:
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = trigrams(text or "")
            total[lang] = total[lang] + got if lang in total else got
        for lang, x in total.items():
            # A language without trigrams has a row all the same.
            at = np.flatnonzero(x) if x.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at], pa.float64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], Table]:
    """(languages, their counts of trigrams: language, bucket, count) from docs(doc_id, text, lang)."""
    rows = docs.where("lang is not null and doc_id is not null").select("doc_id", F.lower("lang").alias("lang"), "text")
    # Only ids are sorted and broadcast, at most LABELLED; texts stay where they are.
    wanted = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = rows.join(F.broadcast(wanted), "doc_id")
    sums = c.map_arrow(rows.select("lang", "text"), _counts, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").combine_chunks().dictionary_encode()
    langs, rank = np.unique(np.array(names.dictionary.to_pylist(), dtype=object), return_inverse=True) if len(names) else (np.empty(0, object), np.empty(0, np.int64))
    at = rank[names.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
    order = np.argsort(at, kind="stable")
    return list(langs), (at[order], sums.column("bucket").to_numpy()[order], sums.column("n").to_numpy()[order])


def _block(table: Table, first: int, last: int) -> np.ndarray:
    """Log likelihoods of trigrams in the languages of a range."""
    lo, hi = np.searchsorted(table[0], [first, last])
    x = np.zeros((last - first, BUCKETS))
    x[table[0][lo:hi] - first, table[1][lo:hi]] = table[2][lo:hi]
    return np.log((x + 0.1) / (x.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))


def _evidence(langs: list[str], table: Table, most: float):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = [(i, min(i + LANGUAGES, len(langs))) for i in range(0, len(langs), LANGUAGES)]
        held = _block(table, *ranges[0]) if len(ranges) == 1 else None
        for whole in batches:
            # With more than one block, each is made anew for a slice of pages, whose counts are held meanwhile.
            for b in [whole] if held is not None else [whole.slice(i, PAGES) for i in range(0, whole.num_rows, PAGES)]:
                ids, urls, pages = (x.to_pylist() for x in b.columns)
                pages = [x or "" for x in pages]
                lls = np.zeros((len(pages), len(langs)))
                counted = None if held is not None else [_sparse(trigrams(text_of(x))) for x in pages]
                for i, j in ranges:
                    block = held if held is not None else _block(table, i, j)
                    for r in range(len(pages)):
                        counts = trigrams(text_of(pages[r])) if counted is None else _dense(*counted[r])
                        n = counts.sum()
                        if n:
                            lls[r, i:j] = (block @ counts) * (min(n * EACH, most) / n)
                rows = []
                for id_, url, page, ll in zip(ids, urls, pages, lls, strict=True):
                    ll = ll - ll.max()
                    p = np.exp(ll)
                    rows.append((id_, *host_of(url), declared(page), ll, p / p.sum()))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["page_id", "host", "domain", "suffix", "declared", "ll", "p"])

    return kernel


def identify(pages: DataFrame, docs: DataFrame, *, most: float = 400.0) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of every row of pages(page_id, url, html).

    most: the tempering of text evidence.  All trigrams of a text are counted, but their mean counts at most as often as
    that, so that long texts do not drown the other evidence.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    langs, table = fit(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    seen = c.stored(c.map_arrow(pages, _evidence(langs, table, most), "page_id long, host string, domain string, suffix string, declared string, ll array<double>, p array<double>"), "evidence")
    k = range(len(langs))
    add = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in k]

    def level(rows: DataFrame, name: str, above: DataFrame | None, up: str | None) -> DataFrame:
        """(name, n: counts of a group, pages: its rows, prior: its shares, smoothed by those of the level above)"""
        names = [x for x in (name, up) if x]
        summed = rows.groupBy(*names).agg(F.count("*").alias("pages"), *add).select(*names, "pages", F.array(*[f"n{i}" for i in k]).alias("n"))
        if above is not None:
            summed = summed.join(above.select(F.col(up).alias("up_"), F.col("prior").alias("base")), F.col(up) == F.col("up_")).drop("up_")
        else:
            whole = rows.agg(*add).first()
            total = sum(whole[i] or 0.0 for i in k)
            base = [((whole[i] or 0.0) + 1 / len(langs)) / (total + 1) for i in k]
            summed = summed.withColumn("base", F.array(*[F.lit(x) for x in base]))
        size = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
        return summed.withColumn("prior", F.transform(F.zip_with("n", "base", lambda n, q: n + WEIGHT * q), lambda x: x / (size + WEIGHT)))

    suffixes = level(seen, "suffix", None, None)
    domains = level(seen, "domain", suffixes, "suffix")
    hosts = c.stored(level(seen, "host", domains, "domain").select("host", F.col("n").alias("host_n"), F.col("base").alias("host_base"), F.col("pages").alias("n")), "hosts")

    told = seen.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n"), *add)
    told = c.stored(told.select("declared", "n", F.array(*[f"n{i}" for i in k]).alias("told_n")), "declared")
    whole = told.agg(F.count("*"), *[F.sum(F.col("told_n")[i]) for i in k]).first()
    totals = F.array(*[F.lit((x or 0.0) + 0.5 * (whole[0] + 1)) for x in whole[1:]])
    says = F.zip_with("told_n", totals, lambda n, total: F.log((n + 0.5) / total))
    zeros = F.array(*[F.lit(0.0)] * len(langs))

    # A host or a declared language may have any share of the pages.
    rows = c.attach(seen, hosts, "host", salt=["page_id", "host"], width=64 + 16 * len(langs))
    rows = c.attach(rows, told, "declared", salt=["page_id", "host"], width=64 + 8 * len(langs))
    # The page's own text must not come back as its host's: it is taken out of the counts.
    prior = F.zip_with(F.zip_with("host_n", "p", lambda n, p: F.greatest(n - p, F.lit(0.0))), "host_base", lambda n, q: F.log(n + WEIGHT * q))
    rows = rows.withColumn("s", F.zip_with(F.zip_with("ll", F.coalesce(says, zeros), lambda a, b: a + b), prior, lambda a, b: a + b))
    best = F.array_max("s")
    probability = 1.0 / F.aggregate(F.transform("s", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    text_lang = F.when(F.array_min("ll") < F.array_max("ll"), pick(F.col("ll")))
    return rows.select("page_id", pick(F.col("s")).alias("lang"), probability.alias("probability"), text_lang.alias("text_lang"), "declared", "host")
