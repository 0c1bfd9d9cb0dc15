"""Hot keys, colliding hashes, many cells and blocks, long inputs, and a brute-force posterior."""

import collections
import itertools
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from logweave.llm import chat, common, embeddings, jaccard, langid, mixing, mpeg, packing, suffix, toxicity, warc


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- shared


def test_components_of_a_star(spark):
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).alias("a"), F.col("id").alias("b"))
    far = spark.range(0, 50).select((F.col("id") + 2 * n).alias("a"), (F.col("id") + 2 * n + 1).alias("b"))
    got = common.components(star.union(far)).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(0, n + 1), (2 * n, 51)]


@pytest.mark.parametrize("width", [64, 1 << 30])
def test_attach(spark, width):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 40}" if i % 7 else None) for i in range(20_000)], "id long, key string")
    values = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k4'").withColumn("twice", F.col("n") * 2)
    want = {r["key"]: r["twice"] for r in values.collect()}
    got = common.attach(rows, common.stored(values, "values"), "key", width=width).collect()
    assert len(got) == 20_000 and all(r["twice"] == want.get(r["key"]) for r in got)


# ---------------------------------------------------------------- 1


def test_embeddings_of_many_cells_and_blocks(spark, monkeypatch):
    for name, value in (("CELL", 40), ("HOMES", 160), ("OTHERS", 320)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(250, 10))
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 10)) * 0.2, x[:9]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rep string"))
    assert sorted(rows_of(got)) == [(i, int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))]


# ---------------------------------------------------------------- 2


def brute_posteriors(pages, docs, langs, most=400.0):
    """Page ids to (language, probability), with dictionaries and loops."""
    counts = {x: collections.Counter() for x in langs}
    for text, lang in docs:
        counts[lang].update({int(k): int(n) for k, n in zip(*langid._sparse(langid.trigrams(text or "")), strict=True)})
    sums = {x: sum(counts[x].values()) + 0.1 * langid.BUCKETS for x in langs}
    seen = []
    for id_, url, html in pages:
        found = collections.Counter({int(k): int(n) for k, n in zip(*langid._sparse(langid.trigrams(langid.text_of(html or ""))), strict=True)})
        n = sum(found.values())
        ll = [sum(m * math.log((counts[x][k] + 0.1) / sums[x]) for k, m in found.items()) * (min(n / 3, most) / n if n else 0) for x in langs]
        p = np.exp(np.array(ll) - max(ll))
        seen.append((id_, *langid.host_of(url), langid.declared(html or ""), np.array(ll), p / p.sum()))
    groups = [collections.defaultdict(lambda: np.zeros(len(langs))) for _ in range(4)]
    for _, host, domain, suffix, told, _, p in seen:
        for g, k in zip(groups, (host, domain, suffix, told), strict=True):
            g[k] = g[k] + p
    total = sum(groups[2].values())
    base = (total + 1 / len(langs)) / (total.sum() + 1)
    smooth = lambda n, q: (n + 4 * q) / (n.sum() + 4)
    told = {k: v for k, v in groups[3].items() if k is not None}
    all_told = sum(told.values()) + 0.5 * (len(told) + 1) if told else None
    out = {}
    for id_, host, domain, suffix, said, ll, p in seen:
        above = smooth(groups[1][domain], smooth(groups[2][suffix], base))
        s = ll + np.log(np.maximum(groups[0][host] - p, 0) + 4 * above)
        if said is not None:
            s = s + np.log((told[said] + 0.5) / all_told)
        q = np.exp(s - s.max())
        out[id_] = (langs[int(s.argmax())], q.max() / q.sum())
    return out


def test_posteriors_equal_brute_force(spark):
    docs, pages = (common.table(spark, "/root/testdata/sf0.001", x) for x in ("documents", "pages"))
    got = {r["page_id"]: (r["lang"], r["probability"]) for r in langid.identify(pages, docs).collect()}
    rows = [(t, x.lower()) for t, x in rows_of(docs.where("lang is not null").select("text", "lang"))]
    want = brute_posteriors(rows_of(pages.select("page_id", "url", "html")), rows, sorted({x for _, x in rows}))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1], rel=1e-6) for k, v in want.items())


def test_long_pages_take_time_in_proportion():
    began = time.perf_counter()
    for page in ("<!--" * 250_000, "<" * 1_000_000, "<script " * 120_000, "<html " * 160_000, "<html lang=" + " " * 1_000_000, "<meta property=og:locale" * 40_000):
        langid.text_of(page), langid.declared(page)
    assert time.perf_counter() - began < 6
    assert langid.text_of("a<!-- x --><b>c</b><script>y</script >d<style>e").split() == ["a", "c", "d", "e"]
    assert [langid.host_of(x) for x in ("http://a.b.co.uk/", "http://[::1]:80/", "http://192.0.2.1/x")] == [("a.b.co.uk", "b.co.uk", "uk"), ("[::1]", "[::1]", ""), ("192.0.2.1", "192.0.2.1", "")]


# ---------------------------------------------------------------- 3


def stream(second, third, n, size, extra=b"", at=0):
    """n frames of a header's second and third byte, of that size; the first holds extra at a place."""
    head = bytes([0xFF, second, third, 0xC0])
    frames = [bytearray(head + bytes(size - 4)) for _ in range(n)]
    frames[0][at : at + len(extra)] = extra
    return b"".join(map(bytes, frames))


def test_versions_layers_and_tables():
    for second, third, size, samples, rate in ((0xFF, 0x10, 32000 * 12 // 44100 * 4, 384, 44100), (0xFD, 0x50, 144 * 80000 // 44100, 1152, 44100), (0xF3, 0x50, 72 * 40000 // 22050, 576, 22050), (0xE3, 0x50, 72 * 40000 // 11025, 576, 11025)):
        x = mpeg.decode(stream(second, third, 5, size))
        assert (x["frames"], x["samples"], x["rate"], x["skipped"]) == (5, 5 * samples, rate, 0)
        assert x["seek"] == [k * size for k in range(5)]
    size = 144 * 64000 // 44100
    vbri = b"VBRI" + bytes(6) + (1000).to_bytes(4, "big") + (7).to_bytes(4, "big") + (2).to_bytes(2, "big") + bytes(2) + (2).to_bytes(2, "big") + bytes(2) + b"\x01\x02\x03\x04"
    x = mpeg.decode(stream(0xFB, 0x50, 4, size, vbri, 36))
    assert x["table"][:3] == ("VBRI", 7, 1000) and x["table"][3] == b"\1\2\3\4" and x["seek"] == [k * size for k in (1, 2, 3)]


# ---------------------------------------------------------------- 4, 9


def test_exported_files_are_plain_archives(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k % 7}", f"<p>{k % 7}</p>" * 900) for k in range(400)], "page_id long, url string, html string")
    files = warc.export_files(warc.write_bundles(pages), str(tmp_path)).collect()
    found = []
    for r in files:
        with open(r["file"], "rb") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        at = 0
        while at < len(data):
            record, at = warc.parse(data, at)
            found.append((record["page_id"], record["record_type"]))
    assert sorted(found) == [(k, "response" if k < 7 else "revisit") for k in range(400)]
    assert not [x for x in tmp_path.iterdir() if x.name.startswith(".")]


def test_sequences_are_near_the_lower_bound(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    total, used = packing.pack(docs).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert used <= math.ceil(-(-total // 2048) * 1.01)


# ---------------------------------------------------------------- 5, 10


def test_toxic_rows_are_caught(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).where("held_out").collect()}
    toxic = [got[r["doc_id"]] for r in labels.where("toxic = 1").collect() if r["doc_id"] in got]
    clean = [got[r["doc_id"]] for r in labels.where("toxic = 0").collect() if r["doc_id"] in got]
    assert sum(toxic) >= 0.85 * len(toxic) > 0 and sum(clean) <= 0.01 * len(clean)


def test_long_tokens_and_turns_take_time_in_proportion():
    began = time.perf_counter()
    assert toxicity.forms("a" + "!" * 500_000 + "b")[1] == "aib"
    assert toxicity.forms("!" * 500_000) == ("", "i")
    for text in ("\\" * 300_000, "\\</s>" * 50_000, "\\" * 300_000 + "</s>"):
        out, begin, end = chat.render("user", text)
        assert chat.parse_turn(out, 0) == ("user", text, begin, end, len(out))
    assert time.perf_counter() - began < 8


def test_turns_are_read_back_in_any_order(spark):
    rows = [(k % 3, k, ("user", "assistant")[k % 2], f"</s> {k}") for k in range(40)]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(rows_of(chat.read_back(turns))) == sorted(rows_of(chat.read_back(turns.orderBy(F.rand(1)))))


# ---------------------------------------------------------------- 6


def test_words_whose_polynomial_hashes_collide(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{a} p q r s"), (2, f"{b} p q r s"), (3, f"{a} p q r s")], "doc_id long, text string")
    assert sorted(rows_of(jaccard.jaccard_join(docs).select("doc_id", "component_id", "n_links"))) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]


def test_exact_sets_do_not_trust_hashes(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join("xy" if rng.random() < 0.1 else "abAB"[rng.integers(4)] * rng.integers(1, 4) for _ in range(rng.integers(0, 14))) for _ in range(300)] + ["", None, "one"]
    words = [re.findall(common.WORD, (t or "").lower()) for t in texts]
    want = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    for _ in range(2):
        got = jaccard.exact_sets(pa.array(texts, pa.large_string()), 5)
        assert [len(x) for x in got] == [len(x) for x in want]
        assert all(len(np.intersect1d(got[i], got[k])) == len(want[i] & want[k]) for i in range(0, 303, 3) for k in range(i, 303, 7))
        monkeypatch.setattr(common, "_word_hashes", lambda data, a, b: (b - a).astype(np.uint64))


def test_a_list_put_together_in_parts():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = np.sort(rng.integers(1, 400, 30))
        whole = np.cumsum(jaccard.blocks(np.zeros(30, np.uint64), n, n, 75))
        part = rng.integers(0, 3, 30)
        low, high = [], []
        for k in range(3):
            mine = n[part == k]
            at = np.flatnonzero(jaccard.blocks(np.zeros(len(mine), np.uint64), mine, mine, 75))
            low += mine[at].tolist()
            high += [mine[j - 1] for j in [*at[1:], len(mine)] if j]
        order = np.argsort(low, kind="stable")
        low, high = np.array(low)[order], np.array(high)[order]
        joined = np.cumsum(jaccard.blocks(np.zeros(len(low), np.uint64), low, high, 75))
        assert joined[-1] == whole[-1]


# ---------------------------------------------------------------- 7


def test_mix_is_near_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(int(1024 * i) if i % 9 else None, " ".join(["w"] * int(rng.integers(1, 60 if i % 5 else 900))), "abcde"[min(int(rng.exponential(1.2)), 4)]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["source"], r["target"], r["source_size"]] += r["taken"]
        assert 0 <= r["copies"] <= 3
    for (_, target, size), words in taken.items():
        assert abs(words - target) <= 1 or target == 3 * size == words
    # Rates fall with size where a source gives less than it has, and rise where it gives more.
    for source in "abcde":
        mine = [(r["size"], r["copies"]) for r in got if r["source"] == source and r["target"] < 2.9 * r["source_size"]]
        if mine:
            small, large = (np.mean([c for n, c in mine if (n > 60) == x]) for x in (False, True))
            more = next(r["target"] > r["source_size"] for r in got if r["source"] == source)
            assert (large > small) == more


def test_tilts_solve_the_dual(spark):
    rng = np.random.default_rng(9)
    sizes = [(p, int(s), int(rng.integers(1, 50))) for p in range(1, 7) for s in np.unique(rng.integers(1, 4000, 80))]
    total = collections.Counter()
    for p, s, n in sizes:
        total[p] += s * n
    shares = {1: 0.001, 2: 0.3, 3: 1.0, 4: 1.7, 5: 2.99, 6: 2.0}
    targets = spark.createDataFrame([(p, total[p], shares[p] * total[p], False) for p in total], "place long, source_size long, target double, capped boolean")
    lam = dict(rows_of(mixing.tilts(targets, spark.createDataFrame(sizes, "place long, size long, n long"))))
    for p in total:
        words = sum(n * s * min(3.0, math.exp(min(lam[p] * s, 2))) for q, s, n in sizes if q == p)
        assert words == pytest.approx(shares[p] * total[p], rel=1e-11)


# ---------------------------------------------------------------- 9


def ids_of(words, texts):
    data, at = common.utf8(pa.array(texts, pa.string()))
    return [np.frombuffer(x, "<u4").tolist() for x in words.ids(data, at)]


def test_runs_are_tokenized_once():
    """New words of known runs ask the tokenizer for nothing, and the ids are its own."""
    words = packing.Words(packing.default_tokenizer())
    asked, encode = [], words.encode
    words.encode = lambda texts: encode([asked.append(t) or t for t in texts])
    parts = ["".join(x) for x in itertools.product("aeiou", "bcdfgklm")]
    texts = [" ".join(f"{x.upper()}-{y}{k % 10}, ({y}É" for k, y in enumerate(parts)) for x in parts]
    assert ids_of(words, texts) == [words.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(len(t.split()) for t in asked) < 200


def test_ids_of_texts_that_lower_case_changes():
    """Letters are composed before they are lower-cased; special tokens, suffixes, signs among letters, digits of all kinds."""
    rnd = random.Random(21)
    atoms = [*"abXY09 \t\n.,'-<|>\x00\x1c\x7fÉé×÷ßÿÞÖ́̌İıΣςβ中 \u0085 ªº²½٣😀‍Kẞ", "J̌", "H̱", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'re"]
    texts = ["J̌ ẖ T̈", None, "", "x" * 5000, "x" * 5000 + "b"] + ["".join(rnd.choices(atoms, k=rnd.randrange(40))) for _ in range(3000)]
    words = packing.Words(packing.default_tokenizer())
    for _ in range(2):
        assert ids_of(words, texts) == [words.model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(map(len, words.known)) <= packing.RUN_BYTES and words.at[len(words.known)] <= len(words.flat)


# ---------------------------------------------------------------- 8


def test_stretches_take_little_memory_and_kinds_are_not_sorted_whole(monkeypatch):
    """Arrays of a slice stay in a core's cache; only stretches whose hash stands elsewhere are put in order by all columns."""
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 123, 4 << 20).astype(np.uint8)
    data[1 << 20 : 5 << 18] = data[: 1 << 18]
    at = np.arange(0, len(data) + 1, 4096)
    common.powers(common.SLICE)
    tracemalloc.start()
    gram, h, a, b, *_, h2 = suffix.stretches(data, at, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 << 20
    windows = np.concatenate([np.arange(x, y + 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert np.array_equal(windows, np.concatenate([np.arange(x, x + 4096 - 99) for x in at[:-1]]))
    lexsort, ordered = np.lexsort, []
    monkeypatch.setattr(np, "lexsort", lambda keys: ordered.append(len(keys[0])) or lexsort(keys))
    first = suffix.first_of_chunk(gram, h, h2)
    seen = set()
    assert first.tolist() == [not (k in seen or seen.add(k)) for k in zip(gram.tolist(), h.tolist(), h2.tolist(), strict=True)]
    assert 0 < (~first).sum() and sum(ordered) <= 2.2 * (~first).sum() < len(h) / 4


def test_intervals_are_extended_without_sorting_their_rows(monkeypatch):
    """An order up to `length` symbols gives the same intervals as the whole order, whatever the number of symbols."""
    rnd = np.random.default_rng(8)
    argsort, ordered = np.argsort, []
    for symbols, length in ((2, 9), (4, 30), (60, 100), (256, 40)):
        base = rnd.integers(1, symbols + 1, 1500).astype(np.int16)
        text = np.concatenate([base, base[200:900], base[::-1], np.ones(300, np.int16), base])
        text[rnd.random(len(text)) < 0.004] = 0
        text[-1] = 0
        sa = suffix.suffix_array(text, length)
        assert sorted(sa.tolist()) == list(range(len(text)))
        ordered.clear()
        monkeypatch.setattr(np, "argsort", lambda x, **k: ordered.append(len(x)) or argsort(x, **k))
        group = np.cumsum(suffix.equal_prefixes(text, sa, length))
        monkeypatch.undo()
        assert sum(ordered) <= len(text)
        stop = np.flatnonzero(text == 0)[np.searchsorted(np.flatnonzero(text == 0), sa)]
        rows = {(int(g), text[i : i + length].tobytes()) for g, i, z in zip(group, sa.tolist(), stop, strict=True) if i + length <= z}
        assert len(rows) == len({r[0] for r in rows}) == len({r[1] for r in rows}) > 0


def test_ranks_of_keys_with_and_without_room_for_places():
    key = np.random.default_rng(2).integers(0, 50, 400)
    for bits in (9, 60):
        rank, order = suffix.ranks(key, bits)
        assert order.tolist() == sorted(range(400), key=lambda i: (key[i], i))
        assert rank.tolist() == (np.unique(key, return_inverse=True)[1] + 1).tolist()


def test_ranges_that_touch_and_cross_are_cut_by_text():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        lens = rnd.integers(0, 6, 30) * rnd.integers(0, 4, 30)
        at = np.concatenate([[0], np.cumsum(lens)])
        data = rnd.integers(0, 256, at[-1]).astype(np.uint8)
        begin = np.sort(rnd.integers(0, at[-1] + 1, rnd.integers(0, 20)))
        end = np.minimum(begin + rnd.integers(1, 9, len(begin)), at[-1])
        begin, end = begin[begin < end], end[begin < end]
        left = pa.table({"chunk": [0], "ids": [np.arange(30).tobytes()], "lengths": [lens.astype(np.int64).tobytes()], "bytes": [data.tobytes()]})
        right = pa.table({"place": pa.array([0] * 2, pa.int64()), "data": pa.array([common.pack(begin[k::2], end[k::2]) for k in (0, 1)], pa.binary())})
        gone = np.zeros(len(data), dtype=bool)
        for x, y in zip(begin, end, strict=True):
            gone[x:y] = True
        got = suffix._cut(left, right)
        texts = [(gone[x:y], data[x:y]) for x, y in itertools.pairwise(at)]
        assert got.column("kept").to_pylist() == [d[~g].tobytes() for g, d in texts]
        assert got.column("n_removed").to_pylist() == [int(g.sum()) for g, _ in texts]
        assert got.column("n_spans").to_pylist() == [int((g & ~np.append(False, g[:-1])).sum()) for g, _ in texts]
