"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Training reads at most LABELLED labelled rows, those of the smallest hashes of doc_id, a documented bound; scoring reads
every whole text.  A lexicon of words and of word beginnings is learned first: entries that many more toxic than other
training texts hold, with log odds as weights.  It is learned on each half of the rows for the features of the other
half, so that no text's own label is in its features, and on all rows for scoring.  Features are densities and sums of
lexicon weights, hits near a second person, hits that show only after look-alike characters are put back, capitals,
punctuation, and sizes.  Trees fit the logistic loss on histograms; margins of each half under the other half's trees
are calibrated by isotonic regression.

Each task counts its texts' entries before they are shuffled; at most ENTRIES entries, those in most toxic texts, and
LABELLED rows of features reach the driver.  Entries are of words of 3 to 40 letters; all words count towards densities.
Null and blank texts are scored like any other, and a text of any length in proportion to it; without labels of both
kinds the score is the share of toxic labels, or 0; several labels of one doc_id count as toxic if one is; a null doc_id
is not held out; repeated rows get equal scores, as do all of equal text; an empty table gives no rows; score() returns
all columns of its input, whatever their names, and toxicity() ignores others than doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logweave.llm import common as c

#: Labelled rows read, lexicon entries kept, words a worker remembers, words between a hit and a second person.
LABELLED, ENTRIES, WORDS, NEAR = 20_000, 20_000, 200_000, 4
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2

# Second persons of some languages, and look-alike characters.
SECOND = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes ti tus vosotros sie ihnen".split())
LOOKALIKE = str.maketrans("013457@$!|+", "oieastasiit")
_LETTER = re.compile(r"[^\W\d_]")
_INSIDE = re.compile(r"[\W\d_]+")
_REPEAT = re.compile(r"(.)\1{2,}")

FEATURES = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def forms(token: str) -> tuple[str, str]:
    """A token's letters, lower-cased, and those after look-alikes, separators and repeats are undone."""
    low = token.lower()
    first = _LETTER.search(low)
    core = low[first.start() : len(low) - _LETTER.search(low[::-1]).start()] if first else ""
    plain = _REPEAT.sub(r"\1", _INSIDE.sub("", low.translate(LOOKALIKE)))
    return core, plain


def entries(core: str) -> Iterator[str]:
    """The word, and its beginnings of 4 to 6 letters, marked as such."""
    if 3 <= len(core) <= 40:
        yield core
        for k in (4, 5, 6):
            if len(core) >= k:
                yield core[:k] + "*"


@lru_cache(1 << 15)
def _entries_of(token: str) -> tuple[str, ...]:
    return tuple(entries(forms(token)[0]))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, fold, texts, toxic texts) of the training rows."""
    counts: dict[tuple[str, int], list[int]] = {}
    for b in batches:
        for text, toxic, fold in zip(*(b.column(x).to_pylist() for x in ("text", "toxic", "fold")), strict=True):
            found = set()
            for token in set((text or "").split()):
                found.update(_entries_of(token))
            for e in found:
                n = counts.setdefault((e, fold), [0, 0])
                n[0] += 1
                n[1] += toxic
    _entries_of.cache_clear()
    keep = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.int64()), pa.array([counts[k][0] for k in keep], pa.int64()), pa.array([counts[k][1] for k in keep], pa.int64())],
        names=["entry", "fold", "n", "toxic"],
    )


def lexicon(counts: list[tuple[str, int, int]], n: int, toxic: int) -> dict[str, float]:
    """Weights of entries from (entry, texts, toxic texts): log odds, for those well above chance."""
    out = {}
    if not toxic or toxic == n:
        return out
    share = toxic / n
    for e, k, t in counts:
        if t < 3:
            continue
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((k - t + 0.5) / (n - toxic + 1))
        if odds > 2 and (t - k * share) > 3 * np.sqrt(k * share * (1 - share)) + 1:
            out[e] = float(odds)
    return out


class Scorer:
    """Features of texts under a lexicon; remembers tokens."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.known = weights, {}

    def token(self, token: str) -> tuple[float, int, int]:
        """(weight, 1 for a plain hit, 2 for a hidden one, 4 for a second person)"""
        core, plain = forms(token)
        if core in SECOND:
            return 0.0, 4, 0
        weight = max((self.weights.get(e, 0.0) for e in entries(core)), default=0.0)
        if weight:
            return weight, 1, 0
        if plain != core and (weight := max((self.weights.get(e, 0.0) for e in entries(plain)), default=0.0)):
            return weight, 2, 0
        return (0.0, 0, 1) if _INSIDE.search(core) and any(x.isdigit() or x in "@$!|+*" for x in core) else None

    def features(self, texts: pa.Array) -> np.ndarray:
        data, at = c.utf8(texts)
        out = np.zeros((len(at) - 1, FEATURES))
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])[at]
        lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])[at]
        shout = np.concatenate([[0], np.cumsum(data == 33)])[at]
        asks = np.concatenate([[0], np.cumsum(data == 63)])[at]
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])[at]
        for i in range(len(at) - 1):
            tokens = data[at[i] : at[i + 1]].tobytes().decode(errors="replace").split()
            known = self.known
            try:
                got = list(map(known.__getitem__, tokens))
            except KeyError:
                if len(known) > WORDS:
                    known.clear()
                for t in tokens:
                    if t not in known:
                        known[t] = self.token(t)
                got = list(map(known.__getitem__, tokens))
            row, n = out[i], max(len(tokens), 1)
            hits, you, odd = [], [], 0
            if any(got):
                for k, g in enumerate(got):
                    if g:
                        odd += g[2]
                        if g[1] == 4:
                            you.append(k)
                        elif g[1]:
                            hits.append((k, g[0], g[1]))
            if hits:
                weights = [h[1] for h in hits]
                strong = [h for h in hits if h[1] > 4]
                row[0] = len(hits)
                row[1] = len(hits) / n
                row[2] = sum(weights)
                row[3] = sum(weights) / n
                row[4] = max(weights)
                row[5] = len(strong)
                row[6] = len({tokens[h[0]].lower() for h in strong})
                row[7] = sum(h[2] == 2 for h in hits) / n
                if you:
                    near = np.searchsorted(you, [h[0] - NEAR for h in hits])
                    row[8] = sum(a < len(you) and you[a] <= h[0] + NEAR for a, h in zip(near, hits, strict=True)) / len(hits)
            row[9] = len(you) / n
            row[10] = odd / n
            row[15] = np.log1p(len(tokens))
        size = np.maximum(np.diff(at), 1)
        out[:, 11] = np.diff(upper) / np.maximum(np.diff(upper) + np.diff(lower), 1)
        out[:, 12] = np.diff(shout) / size
        out[:, 13] = np.diff(asks) / size
        out[:, 14] = np.diff(marks) / size
        return out


_MARK = np.zeros(256, dtype=bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(first margin, [(features, thresholds, leaves)]) of trees of full depth, by Newton steps on the logistic loss."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(n, start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            width_l = 2**level
            best, pick, cut = np.full(width_l, 1e-6), np.zeros(width_l, np.int64), np.full(width_l, -1)
            for j in range(width):
                if not len(edges[j]):
                    continue
                at = node * BINS + codes[j]
                gs, hs, ns = (np.bincount(at, w, width_l * BINS).reshape(width_l, BINS).cumsum(1) for w in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(nl < 5) | (nr < 5)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width_l), k] > best
                best[better], pick[better], cut[better] = gain[np.arange(width_l), k][better], j, k[better]
            for q in range(width_l):
                if cut[q] >= 0:
                    feature[width_l - 1 + q], threshold[width_l - 1 + q] = pick[q], edges[pick[q]][cut[q]]
            node = 2 * node + (x[np.arange(n), feature[width_l - 1 + node]] > threshold[width_l - 1 + node])
        leaves = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
        margin += leaves[node]
        trees.append((feature, threshold, leaves))
    return start, trees


def margins(x: np.ndarray, model: tuple) -> np.ndarray:
    out, rows = np.full(len(x), model[0]), np.arange(len(x))
    for feature, threshold, leaves in model[1]:
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > threshold[at])
        out += leaves[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (margins, shares of toxic) to interpolate between."""
    values, at = np.unique(margin, return_inverse=True)
    weight, total = np.bincount(at.reshape(-1)).astype(float), np.bincount(at.reshape(-1), y)
    blocks: list[list[float]] = []
    for v, w, t in zip(values, weight, total, strict=True):
        blocks.append([v, v, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, w2, t2 = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = hi, blocks[-1][2] + w2, blocks[-1][3] + t2
    xs = np.array([b[k] for b in blocks for k in (0, 1)])
    return xs, np.repeat([b[3] / b[2] for b in blocks], 2)


def apply(x: np.ndarray, model: dict) -> np.ndarray:
    if model["trees"] is None:
        return np.full(len(x), model["share"])
    m = margins(x, model["trees"])
    # A thousandth of the plain probability keeps the order inside a calibrated block.
    return np.clip(0.999 * np.interp(m, *model["calibration"]) + 0.001 / (1 + np.exp(-m)), 0.0, 1.0)


def _train_features(halves: list[dict[str, float]]):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(w) for w in halves]
        for b in batches:
            fold = b.column("fold").to_numpy()
            x = np.zeros((b.num_rows, FEATURES))
            for k in (0, 1):  # features of one half come from the lexicon of the other
                mine = np.flatnonzero(fold == k)
                if len(mine):
                    x[mine] = scorers[1 - k].features(b.column("text").take(pa.array(mine)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("fold"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    return kernel


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> dict:
    """The model, from labels(doc_id, toxic) that are not held out and their docs(doc_id, text)."""
    c.prepare(docs.sparkSession)
    wanted = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("long").alias("toxic")).where("label_id is not null and toxic is not null").where(~held_out(F.col("label_id")))
    wanted = wanted.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).alias("fold")
    rows = c.stored(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("long").alias("toxic"), fold), "labelled")
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("fold").agg(F.count("*"), F.sum("toxic")).collect()}
    n, toxic = (sum(v[k] for v in sizes.values()) for k in (0, 1))
    model = {"share": toxic / n if n else 0.0, "weights": {}, "trees": None, "calibration": None}
    if not 0 < toxic < n:
        return model
    counts = c.map_arrow(rows, _count, "entry string, fold long, n long, toxic long").groupBy("entry").agg(
        F.sum(F.when(F.col("fold") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("fold") == 0, F.col("toxic")).otherwise(0)).alias("t0"), F.sum("n").alias("n"), F.sum("toxic").alias("toxic")
    )
    counts = counts.where(f"toxic >= 3 and toxic * {n - toxic} > 4 * (n - toxic) * {toxic}").orderBy(F.desc("toxic"), "n", "entry").limit(ENTRIES).collect()
    n0, t0 = sizes.get(0, (0, 0))
    halves = [lexicon([(r[0], r[1], r[2]) for r in counts], n0, t0), lexicon([(r[0], r[3] - r[1], r[4] - r[2]) for r in counts], n - n0, toxic - t0), lexicon([(r[0], r[3], r[4]) for r in counts], n, toxic)]
    got = sorted(tuple(r) for r in c.map_arrow(rows, _train_features(halves[:2]), "doc_id long, toxic long, fold long, x array<double>").collect())
    c.dropped(rows)
    y, f, x = np.array([r[1] for r in got], dtype=float), np.array([r[2] for r in got]), np.array([r[3] for r in got])
    other = np.empty(len(y))
    for k in (0, 1):
        other[f == k] = margins(x[f == k], fit_trees(x[f != k], y[f != k])) if (f != k).any() and 0 < y[f != k].sum() < (f != k).sum() else 0.0
    return model | {"weights": halves[2], "trees": fit_trees(x, y), "calibration": isotonic(other, y)}


def _score(model: dict, text: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model["weights"])
        for b in batches:
            at = c.utf8(b.column(text))[1]
            for i, j in c.slices(at):
                part = b.slice(i, j - i)
                score = apply(scorer.features(part.column(text)), model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*b.schema.names, "toxicity_score_"])

    return kernel


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with a last column toxicity_score_: 0 to 1, higher where a toxic label is likelier."""
    c.prepare(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("toxicity_score_", DoubleType())])
    return c.map_arrow(docs, _score(model, docs.columns.index(text)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score_").alias("score"), (F.col("toxicity_score_") >= threshold).cast("int").alias("predicted"))
