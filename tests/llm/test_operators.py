"""The ten operators against brute force, round trips and held-out labels, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from logweave.llm import chat, common, embeddings, jaccard, langid, mixing, mpeg, packing, queries, suffix, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for x in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{SF}/{x}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, rows_of(df.select(*names)))) == sorted(map(str, cursor.fetchall()))


# ---------------------------------------------------------------- 1


def links_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 8)) * 0.15, x[:5], x[:3] * 7])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [1.0, 2.0]), (906, [1.0, 2.0])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and u[i] @ u[j] >= 0.95] + [(905, 906), (906, 905)]
    n, root = collections.Counter(a for a, _ in pairs), links_of([r[0] for r in rows], pairs)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(rows_of(embeddings.near_duplicates(df))) == sorted((i, n[i], root[i], root[i] == i) for i, _ in rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_cells_lose_no_link():
    rng = np.random.default_rng(2)
    x = embeddings.unit(rng.normal(size=(300, 6)))
    y = embeddings.unit(x + rng.normal(size=x.shape) * 0.1)
    centers = embeddings.spherical_kmeans(x, 12)
    home, near, guest = embeddings._assign(x, centers, 0.95)
    theirs = embeddings._assign(y, centers, 0.95)[0]
    linked = np.einsum("ij,ij->i", x, y) >= 0.95
    assert linked.any() and all(h == t or g[t] for h, t, g in zip(home[linked], theirs[linked], guest[linked], strict=True))


# ---------------------------------------------------------------- 2


def test_language(spark, docs):
    pages = common.table(spark, SF, "pages")
    got = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    truth = {r["page_id"]: re.search(r"://[^/]+/([a-z]{2})/", r["url"]) for r in pages.collect()}
    known = {i: m[1] for i, m in truth.items() if m}
    assert sum(got[i]["lang"] == x for i, x in known.items()) >= 0.95 * len(known)
    odd = spark.createDataFrame([(1, None, None), (2, "http://a.fr/", ""), (2, "http://a.fr/", ""), (None, "::", "<html lang=zz>")], "page_id long, url string, html string")
    assert langid.identify(odd, docs).count() == 4
    assert langid.identify(odd, docs.limit(0)).where("lang is not null").count() == 0
    assert langid.identify(odd.limit(0), docs).count() == 0


def test_host_and_declared():
    assert langid.host_of("https://u@News.Example.co:80/x") == ("news.example.co", "example.co", "co")
    assert langid.host_of(None) == ("", "", "")
    assert langid.declared('<html class=x lang="FR-ca">') == "fr"
    assert langid.declared("<p lang=de>") is None


# ---------------------------------------------------------------- 3


def test_mpeg_round_trip():
    rnd = random.Random(4)
    for n in (0, 1, 63, 64, 65, 1020, 1021, 1022, 5000, 100_000):
        text = bytes(rnd.randrange(256) for _ in range(n))
        x = mpeg.decode(mpeg.encode(text))
        assert x["payload"] == text.ljust(max(64, -(-n // 64) * 64), b"\0") and x["n_bytes"] == n
        assert (x["bad"], x["skipped"], x["good"], x["table"][1], x["samples"]) == (0, 0, x["frames"], x["frames"], 1152 * x["frames"])


def test_mpeg_resynchronises():
    media = mpeg.encode(b"TAG" * 2000)
    x = mpeg.decode(media)
    assert x["skipped"] == 0
    cut = x["seek"][2]
    y = mpeg.decode(media[:cut] + b"\xff\xfbnoise\xff" * 9 + media[cut:] + b"TAG".ljust(128, b"\0"))
    assert y["frames"] == x["frames"] and y["payload"] == x["payload"] and y["skipped"] == 72
    broken = bytearray(media)
    broken[x["seek"][1] + 8] ^= 1
    assert mpeg.decode(bytes(broken))["bad"] == 1
    assert mpeg.decode(b"")["frames"] == mpeg.decode(b"\xff" * 50)["frames"] == 0


def test_mpeg_features(odd_docs, no_docs):
    got = mpeg.read_media(mpeg.write_media(odd_docs)).collect()
    texts = collections.Counter((r["doc_id"], hashlib.sha256(((t := (r["text"] or "").encode()).ljust(max(64, -(-len(t) // 64) * 64), b"\0"))).hexdigest()) for r in odd_docs.collect())
    assert collections.Counter((r["doc_id"], r["payload_sha256"]) for r in got) == texts
    assert mpeg.read_media(mpeg.write_media(no_docs)).count() == 0


# ---------------------------------------------------------------- 4


def test_seekable_bundles():
    bundle, records = warc.Seekable(), [bytes([i]) * (i * 40_000) for i in range(1, 12)]
    at = [bundle.add(r) for r in records]
    data = bundle.close()
    assert len(warc.seek_table(data)) > 3
    assert [warc.read_record(data, *x) for x in at] == records


def test_warc_odd_pages(spark):
    long = "é" * 200_000
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (3, "u", long), (9, "u", "x" * 99), (8, "u", "x" * 99), (1, "u", None), (None, "u", long), (2, "u", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(df)).collect())
    big = 400_000
    assert got == [(0, big, "revisit", 3), (1, 0, "response", None), (2, 240, "response", None), (3, big, "response", None), (3, big, "response", None), (5, big, "revisit", 3), (8, 99, "response", None), (9, 99, "response", None)]
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


# ---------------------------------------------------------------- 5


def test_toxicity(spark, odd_docs, no_docs):
    d, labels = (common.table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}


def test_isotonic():
    x, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1])
    fitted = np.interp(x, *toxicity.isotonic(x, y))
    assert fitted.tolist() == [0, 0.5, 0.5, 1, 1]


# ---------------------------------------------------------------- 6


def brute_jaccard(rows):
    sets = []
    for i, text in rows:
        w = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    linked = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= 75 * len(sets[a][1] | sets[b][1])]
    n = collections.Counter(a for a, _ in linked)
    ids = [s[0] for s in sets]
    root = links_of([i for i in ids if i is not None], [(ids[a], ids[b]) for a, b in linked if ids[a] is not None and ids[b] is not None])
    return sorted(((i, len(s), root.get(i), n[k]) for k, (i, s) in enumerate(sets)), key=str)


def test_jaccard(spark, docs, odd_docs, no_docs):
    assert sorted(rows_of(jaccard.jaccard_join(docs)), key=str) == brute_jaccard(rows_of(docs.select("doc_id", "text")))
    assert sorted(rows_of(jaccard.jaccard_join(odd_docs)), key=str) == brute_jaccard(rows_of(odd_docs.select("doc_id", "text")))
    assert jaccard.jaccard_join(no_docs).count() == 0


def test_jaccard_blocks_and_answers(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(k, " ".join(x if rnd.random() > rnd.choice((0.005, 0.03)) else f"z{rnd.randrange(10**6)}" for x in base)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(rows_of(jaccard.jaccard_join(df)), key=str) == brute_jaccard(rows)


# ---------------------------------------------------------------- 7


def test_mixing(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        x = by[r["source"]]
        x[0] += r["size"]
        x[1] += r["taken"]
        x[2] = r["target"]
        assert r["source_size"] == sum(q["size"] for q in got if q["source"] == r["source"])
    assert sum(x[2] for x in by.values()) == pytest.approx(sum(x[0] for x in by.values()))
    assert all(x[2] <= 3 * x[0] + 1e-6 for x in by.values())
    assert mixing.mix(no_docs).count() == 0


# ---------------------------------------------------------------- 8


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        x = (text or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            w = x[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix(docs, odd_docs, no_docs):
    assert sorted(rows_of(suffix.remove_repeats(docs).drop("kept")), key=str) == brute_repeats(rows_of(docs.select("doc_id", "text")))
    assert sorted(rows_of(suffix.remove_repeats(odd_docs).drop("kept")), key=str) == brute_repeats(rows_of(odd_docs.select("doc_id", "text")))
    assert suffix.remove_repeats(no_docs).count() == 0
    whole = suffix.without_repeats(odd_docs)
    assert whole.columns == odd_docs.columns and whole.count() == odd_docs.count()


def test_equal_prefixes():
    rnd = np.random.default_rng(6)
    for n, symbols in ((1, 3), (2, 3), (50, 3), (400, 3), (400, 2), (900, 5), (900, 40)):
        for gaps in (1, 0.02, 0.2):
            text = rnd.integers(1, symbols, n).astype(np.int16) if symbols > 2 else np.ones(n, np.int16)
            text[rnd.random(n) < gaps / 4] = 0
            text[-1] = 0
            sa = suffix.suffix_array(text)
            whole = [tuple(text[i : i + 1 + int(np.argmin(text[i:] != 0))]) for i in range(n)]
            assert sa.tolist() == sorted(range(n), key=lambda i: (whole[i], i))
            for length in (1, 3, 8):
                group = np.cumsum(suffix.equal_prefixes(text, sa, length))
                pre = {int(i): whole[i][:length] for i in sa if len(whole[i]) > length}
                rows = [(group[k], pre[int(i)]) for k, i in enumerate(sa) if int(i) in pre]
                assert len(set(rows)) == len({r[0] for r in rows}) == len({r[1] for r in rows})


def test_hot_gram_and_repeats(spark):
    """A passage that is cut short and goes on in many ways, in many texts, and very long texts."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(40))
    rows = []
    for k in range(300):
        a, b = sorted(rnd.sample(range(len(common)), 2))
        rows.append((k // 2 * (-1) ** k, f"{word()} {word()} {common[a:b]} {word()} {word()} {common[: rnd.randrange(280)]}"))
    rows += [(None, common), (900, "é" * 3000), (901, "a b c " * 2000), (902, "x" * 5000), (903, common + "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(rows_of(suffix.remove_repeats(df).drop("kept")), key=str) == brute_repeats(rows)


# ---------------------------------------------------------------- 9


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(odd_docs, capacity=64).collect()
    wanted = collections.Counter()
    for r in odd_docs.collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.update((r["doc_id"], k, x, len(ids[x : x + 64]), zlib.crc32(ids[x : x + 64].tobytes())) for k, x in enumerate(range(0, len(ids), 64)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    assert packing.pack(no_docs).count() == 0


def check_sequences(rows, capacity):
    by = collections.defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_layouts():
    rnd = random.Random(7)

    def best(sizes, capacity):
        todo, n = {tuple(sorted(sizes, reverse=True))}, 0
        while todo:
            n, new = n + 1, set()
            for items in todo:
                if not items:
                    return n - 1

                def fill(rest, room, left, first, new=new):
                    new.add(tuple(left + rest))
                    for i, x in enumerate(rest):
                        if x <= room:
                            fill(rest[i + 1 :], room - x, left + rest[:i], False)

                fill(list(items[1:]), capacity - items[0], [], True)
            todo = new

    for _ in range(60):
        sizes = [rnd.randrange(1, 20) for _ in range(rnd.randrange(1, 9))]
        fixed, left = packing.reduce_by_dominance(dict(collections.Counter(sizes)), 20)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert best(sizes, 20) == sum(t for _, t in fixed) + (best(rest, 20) if rest else 0)
        assert all(sum(s) <= 20 for s, _ in fixed + packing.best_fit(left, 20))


# ---------------------------------------------------------------- 10


def test_chat_round_trip():
    rnd = random.Random(8)
    parts = [*chat.CONTROLS, "\\", "\\\\", " ", "\n", "x", "[/", "INST]", "</", "s>", "<"]
    turns = [(rnd.choice(["user", "assistant", "system", "", "tool] x"]), "".join(rnd.choice(parts) for _ in range(rnd.randrange(6)))) for _ in range(3000)]
    text = chat.START + "".join(chat.render(*x)[0] for x in turns)
    assert list(chat.Parser().feed(text)) == turns
    for size in (1, 7, 1000):
        parser = chat.Parser()
        assert [x for i in range(0, len(text[:20_000]), size) for x in parser.feed(text[: 20_000][i : i + size])] == list(chat.Parser().feed(text[:20_000]))


def test_chat_odd(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a" * 500_000), (1, 1, "assistant", "a" * 500_000), (2, None, None, "</s>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 1_000_000), 2: (1, 0), None: (1, 0)}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# ---------------------------------------------------------------- shared, pipeline


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)]
    got = dict(rows_of(common.components(spark.createDataFrame(pairs, "a long, b long"))))
    pairs = [(a, b) for a, b in pairs if a != b]
    assert got == links_of({x for p in pairs for x in p}, pairs)


def test_words():
    data, at = common.utf8(pa.array(["A b", None, "c\x0bb", "b"]))
    h, text = common.words(data, at[:-1])
    assert text.tolist() == [0, 0, 2, 2, 3] and h[1] == h[3] == h[4] and len(set(h.tolist())) == 3


def test_pipeline(spark, docs):
    state, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows_of(state.select("doc_id", "text"))
        state = common.stored(stage(spark, state, SF), name)
        assert state.columns == docs.columns
        kept.append((name, before, rows_of(state.select("doc_id", "text"))))
    (_, _, clean), (_, _, single), (_, before, cut), (_, _, mixed) = kept
    assert len(clean) < docs.count()
    assert sorted(i for i, _ in single) == sorted(r[0] for r in brute_jaccard(clean) if r[0] == r[2])
    sizes = {r[0]: r[1] - r[2] for r in brute_repeats(before)}
    assert all(sizes[i] - 8 * 4 <= len(t.encode()) <= sizes[i] for i, t in cut)
    assert {i for i, _ in mixed} <= {i for i, _ in cut} and max(collections.Counter(i for i, _ in mixed).values()) <= 3
    packed = corpus_pipeline.packed(spark, state, SF).collect()
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in packed], 2048)
    assert corpus_pipeline.packed(spark, state.limit(0), SF).count() == 0
