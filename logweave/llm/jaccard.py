"""Exact Jaccard self join of word n-gram sets with set-relation skipping.

1. Every text becomes the set of hashes of its word n-grams; equal sets become one class, whose id is a 64-bit hash of
   the set.  Chunks of sets send their shingles to buckets, which count each over all chunks and send the counts back.
   Counts only order shingles: any order gives the same result.
2. Each class sends its prefix, the rarest shingles that a partner must share, to buckets of shingles.  There, and before
   in each chunk, the lists are laid out by set size and cut into blocks wherever the next size is too large for a link;
   sets of one block go to one cluster.  A link's two sets always share a prefix shingle in one block, so no link leaves its cluster.
   A shingle of one class alone goes nowhere, so a class with too few shared shingles is in no cluster.
   One set of each class in a cluster then does both steps once more, with counts that no copies raise.
3. Texts of a cluster meet in blocks of about BLOCK shingles.  A set's overlaps with all indexed sets come from the lists
   of its shingles, of which only the block of fitting sizes is read (short lists whole); for a set much like one already answered, from
   that set's overlaps, less the lists it lacks, plus the lists it adds.  Links are counted, and leave as a forest.
4. Components of the links, with copies counted by the size of their class.

Memory: a task holds a chunk of sets, one bucket of shingles or two blocks of sets.  A cluster of any size is cut into pairs of blocks.
Hashes of shingles only propose clusters: overlaps are counted on words and n-grams that are compared as they are.  Sets
of one 64-bit hash (BLAKE2b over all shingle hashes, of which a word's depend on each byte and its place) are taken as equal.  Null and blank texts have the empty set and link with nothing;
rows that share a doc_id are one node of the links; rows of null doc_id are counted as partners and get a null
component; texts of any length are read whole; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common as c

#: Shingles in a chunk of sets.
HELD = 2_000_000
#: Shingles in a bucket; shingles in a block of sets, and of small clusters in a task; overlap vectors kept for reuse.
BUCKET, BLOCK, TOGETHER, ANSWERS = 500_000, 2_000_000, 500_000, 16
#: Entries of lists read at once; entries up to which a list is read whole.
EXPANDED, SHORT = 1 << 20, 64

_ODD = c.mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of words; a text of fewer words gives one of them all."""
    data, at = c.utf8(texts)
    for i, j in c.slices(at):
        h, text = c.words(data[at[i] : at[j]], at[i:j] - at[i])
        edges = np.searchsorted(text, np.arange(j - i + 1))
        n = len(h) - size + 1
        grams = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(size if n > 0 else 0):
            grams += h[k : k + n] * _ODD[k]
        grams = c.mix(grams)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield c.mix((h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)


def exact_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, text number) of every word of texts data[at[i]:at[i + 1]]: equal words, and only these, have one number."""
    numbers: dict[bytes, int] = {}
    out, texts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for i, j in c.slices(at):
        part = lower[data[at[i] : at[j]]]
        h, text = c.words(part, at[i:j] - at[i])
        a, b = c.word_bounds(part, at[i:j] - at[i])
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        which, n = which.reshape(-1), b - a
        # Hashes only propose which words are equal: bytes decide.
        like = first[which]
        same = bool((n == n[like]).all())
        for x in range(0, len(a) if same else 0, 1 << 17):
            m, k = n[x : x + (1 << 17)], np.arange(x, min(x + (1 << 17), len(a)))
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            same = same and bool((part[np.repeat(a[k], m) + step] == part[np.repeat(a[like[k]], m) + step]).all())
        if not same:
            first, which = np.arange(len(a)), np.arange(len(a))
        known = np.array([numbers.setdefault(part[x:y].tobytes(), len(numbers)) for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True)], dtype=np.int64)
        out.append(known[which])
        texts.append(text + i)
    return np.concatenate(out), np.concatenate(texts)


def exact_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """As shingle_sets, but with numbers that stand for one n-gram each among these texts, whatever hashes say."""
    data, at = c.utf8(texts)
    word, text = exact_words(data, at)
    edges = np.searchsorted(text, np.arange(len(at)))
    count = np.diff(edges)
    # A text of fewer words is one n-gram, filled up with -1; no n-gram crosses a text's end.
    begins = np.ones(len(word), dtype=bool)
    left = edges[text + 1] - np.arange(len(word))
    begins[(left < size) & (count[text] >= size)] = False
    begins[(count[text] < size)] = False
    begins[edges[:-1][(count > 0) & (count < size)]] = True
    start = np.flatnonzero(begins)
    gram = word[start]
    for k in range(1, size):
        have = left[start] > k
        following = np.where(have, word[np.minimum(start + k, max(len(word) - 1, 0))], -1)
        gram = np.unique(gram * (len(word) + 2) + following + 1, return_inverse=True)[1].reshape(-1)
    cuts = np.searchsorted(start, edges)
    return [np.unique(gram[x:y]).astype(np.uint64) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _zip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, packed one by one: they are about to be shuffled."""
    for b in batches:
        data, at = c.utf8(b.column(1))
        packed = [zstandard.compress(data[x:y].tobytes(), 3) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["doc_id", "text"])


def _keyed(size: int):
    """(key, packed text) of a text of each set that a task meets."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, rows = [], []
            for i, s in enumerate(shingle_sets(b.column(0), size)):
                if len(s) and (k := set_key(s)) not in seen:
                    seen.add(k)
                    keys.append(k)
                    rows.append(zstandard.compress(b.column(0)[i].as_py().encode(), 3))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["key", "text"])

    return kernel


def unzipped(column) -> pa.Array:
    return pa.array([zstandard.decompress(x.as_py(), max_output_size=1 << 31) for x in column], pa.large_binary())


def set_key(s: np.ndarray) -> int:
    """A hash of a set as a signed long."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def edges(buckets: int, bits: int) -> np.ndarray:
    """Where ranges of tokens begin and end that part a space of so many bits into buckets."""
    return np.array([-(-(i << bits) // buckets) for i in range(buckets + 1)], dtype=np.uint64)


def _joined(head: bytes, tail: bytes) -> bytes:
    return len(head).to_bytes(8, "little") + head + tail


def _parted(row: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(row[:8], "little")
    return row[8 : 8 + n], row[8 + n :]


def _chunks(size: int, bits: int, cuts: np.ndarray, packed: bool = False):
    """Each row's set size and class; of each chunk of sets, its tokens by bucket, and (bucket -1) whose they are."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        keys: list[int] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not sets:
                return
            n = np.array([len(s) for s in sets], dtype=np.uint32)
            token = np.concatenate(sets) >> np.uint64(64 - bits)
            o = np.argsort(token, kind="stable")
            token, owner = token[o], np.repeat(np.arange(len(sets), dtype=np.uint32), n)[o]
            first = np.flatnonzero(np.concatenate([token[:1] == token[:1], token[1:] != token[:-1]]))
            times = np.diff(first, append=len(token)).astype(np.uint32)
            token = token[first]
            # The chunk's number is random: both of its uses read this table.
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            rows, ids = [_joined(c.pack(np.array(keys, dtype=np.int64), n), _joined(c.pack(times), c.pack(owner)))], [-1]
            at = np.searchsorted(token, cuts)
            for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
                x, y = at[i], at[i + 1]
                rows.append(c.pack(np.diff(token[x:y], prepend=cuts[i]), times[x:y]))
                ids.append(i)
            none = pa.nulls(len(rows), pa.int64())
            sets.clear()
            keys.clear()
            seen.clear()
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([chunk] * len(rows), pa.int64()), pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=NAMES)

        held = 0
        for b in batches:
            n, key = [], []
            for s in shingle_sets(unzipped(b.column(1)) if packed else b.column(1), size):
                n.append(len(s))
                key.append(k := set_key(s) if len(s) else None)
                if k is not None and k not in seen:
                    seen.add(k)
                    sets.append(s)
                    keys.append(k)
                    held += len(s)
                    if held > HELD:
                        yield from flush()
                        held = 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.int64()), none, none, pa.nulls(len(n), pa.binary())], names=NAMES)
        yield from flush()

    return kernel


def _counts(cuts: np.ndarray):
    """A bucket's tokens are counted over all chunks; each chunk hears the counts of its tokens, and which are shared."""

    def kernel(t: pa.Table) -> pa.Table:
        first = cuts[t.column("bucket")[0].as_py()]
        lists = [c.unpack(row.as_py(), np.uint64, np.uint32) for row in t.column("data")]
        token = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists])
        times = np.concatenate([x[1] for x in lists]).astype(np.int64)
        o = np.argsort(token, kind="stable")
        run = np.cumsum(np.concatenate([[0], token[o][1:] != token[o][:-1]]))
        total = np.empty(len(o), dtype=np.uint32)
        total[o] = np.minimum(np.bincount(run, times[o]), 1 << 31).astype(np.uint32)[run]
        rows, at = [], 0
        for x in lists:
            df, tok = total[at : at + len(x[0])], token[at : at + len(x[0])] + first
            at += len(x[0])
            rows.append(_joined(c.pack(df), c.pack(np.diff(tok[df > 1], prepend=first))))
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "data": pa.array(rows, pa.binary())})

    return kernel


def least_overlap(a, b, percent: int):
    """The smallest intersection with which sets of sizes a and b link: 100 i >= percent (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


def _prefixes(percent: int, cuts: np.ndarray):
    """Of each class of a chunk the shared tokens in its prefix, the rarest first; tokens of one class alone match none.

    A token's list is put together within the chunk: links between its sets, and one posting for each block of sizes, so
    that a token that very many sets have sends few postings.
    """

    def kernel(t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("bucket").to_numpy())
        rows = t.column("data")
        head, tail = _parted(rows[int(o[0])].as_py())
        key, n = c.unpack(head, np.int64, np.uint32)
        tail = _parted(tail)
        times, owner = c.unpack(tail[0], np.uint32)[0], c.unpack(tail[1], np.uint32)[0]
        buckets = t.column("bucket").to_numpy()[o[1:]]
        df, shared = [], []
        for i, bucket in zip(o[1:].tolist(), buckets.tolist(), strict=True):
            counts, gaps = _parted(rows[i].as_py())
            df.append(c.unpack(counts, np.uint32)[0])
            shared.append(np.cumsum(c.unpack(gaps, np.uint64)[0], dtype=np.uint64) + cuts[bucket])
        df = np.concatenate(df)
        token = np.zeros(len(df), dtype=np.uint64)
        token[df > 1] = np.concatenate(shared)
        df, token = np.repeat(df, times), np.repeat(token, times)
        n = n.astype(np.int64)
        room = n - -(-percent * n // 100) + 1 - np.bincount(owner[df == 1], minlength=len(n))
        at = np.flatnonzero((df > 1) & (room > 0)[owner])
        at = at[np.lexsort((token[at], df[at], owner[at]))]
        start = np.searchsorted(owner[at], np.arange(len(n)))
        at = at[np.arange(len(at)) - start[owner[at]] < room[owner[at]]]
        at = at[np.lexsort((n[owner[at]], token[at]))]
        token, owner = token[at], owner[at]
        new = blocks(token, n[owner], n[owner], percent)
        # Sets of one block are linked here; for the block goes its first set, with the least and the largest size.
        first = np.flatnonzero(new)
        lead = owner[first[np.cumsum(new) - 1]] if len(first) else owner
        x, y = c.roots(owner, lead)
        token, owner, last = token[first], owner[first], n[owner[np.append(first[1:], len(owner)) - 1]] if len(first) else n[:0]
        ids, out = [], []
        edge = np.searchsorted(token, cuts)
        for i in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            p, q = edge[i], edge[i + 1]
            sets, of = np.unique(owner[p:q], return_inverse=True)
            out.append(_joined(c.pack(key[sets], n[sets].astype(np.uint32)), c.pack(np.diff(token[p:q], prepend=np.uint64(0)), of.reshape(-1).astype(np.uint32), last[p:q].astype(np.uint32))))
            ids.append(i)
        links = x != y
        none, nothing = pa.nulls(int(links.sum()), pa.int64()), pa.nulls(len(ids), pa.int64())
        return pa.table({
            "bucket": pa.concat_arrays([pa.array(ids, pa.int64()), none]), "postings": pa.concat_arrays([pa.array(out, pa.binary()), pa.nulls(len(none), pa.binary())]),
            "a": pa.concat_arrays([nothing, pa.array(key[x[links]])]), "b": pa.concat_arrays([nothing, pa.array(key[y[links]])]),
        })

    return kernel


def blocks(token: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Where, in ranges of sizes in order of token and low, a block begins: no set before it in the list could link with one from it on."""
    new = np.ones(len(token), dtype=bool)
    if len(token):
        rank = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        most = np.maximum.accumulate(rank << 33 | high.astype(np.int64)) & ((1 << 33) - 1)
        new[1:] = (token[1:] != token[:-1]) | (100 * most[:-1] < percent * low[1:].astype(np.int64))
    return new


def _stars(percent: int):
    """Of each shingle's list, the blocks' sets that could link go to the first set of their block."""

    def kernel(t: pa.Table) -> pa.Table:
        rows = t.column("postings").to_pylist()
        token, key, low, high = [], [], [], []
        for r in rows:
            head, tail = _parted(r)
            keys, sizes = c.unpack(head, np.int64, np.uint32)
            gaps, of, most = c.unpack(tail, np.uint64, np.uint32, np.uint32)
            token.append(np.cumsum(gaps, dtype=np.uint64))
            key.append(keys[of])
            low.append(sizes[of])
            high.append(most)
        token, key, low, high = (np.concatenate(x) for x in (token, key, low, high))
        o = np.argsort(token, kind="stable")
        same = np.zeros(len(o) + 1, dtype=bool)
        same[1:-1] = token[o][1:] == token[o][:-1]
        o = o[same[1:] | same[:-1]]
        o = o[np.lexsort((key[o], low[o], token[o]))]
        token, key, low, high = token[o], key[o], low[o], high[o]
        new = blocks(token, low, high, percent)
        lead = key[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else key
        a, b = c.roots(key, lead)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return kernel


def within(lists: np.ndarray, a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list lists[a:b], in order, where its entries from lo to below hi begin and end; all of a list of up to SHORT entries."""
    a, b = a.copy(), b.copy()
    long = np.flatnonzero(b - a > SHORT)
    if len(long):
        ends = []
        for x in (lo, hi):
            i, j = a[long], b[long]
            while len(still := np.flatnonzero(i < j)):
                mid = (i[still] + j[still]) >> 1
                less = lists[mid] < x
                i[still[less]] = mid[less] + 1
                j[still[~less]] = mid[~less]
            ends.append(i)
        a[long], b[long] = ends
    return a, b


def overlaps_join(queries: list[np.ndarray], indexed: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places in indexed of the sets that link with query i), each from the index's lists or from a like query's answer."""
    sizes = np.array([len(s) for s in indexed], dtype=np.int64)
    by_size = np.argsort(sizes, kind="stable")
    sizes = sizes[by_size]
    flat = np.concatenate([indexed[i] for i in by_size]) if len(indexed) else np.empty(0, np.uint64)
    # Stable: the entries of a list stay in order of set size.
    order = np.argsort(flat, kind="stable")
    lists = np.repeat(np.arange(len(by_size), dtype=np.int32), sizes)[order]
    flat = flat[order]
    del order
    starts = np.flatnonzero(np.concatenate([flat[:1] == flat[:1], flat[1:] != flat[:-1]]))
    tokens, starts = flat[starts], np.append(starts, len(flat))
    del flat

    def counts(ids: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How often places lo to hi stand in these lists; the blocks outside are skipped."""
        a, b = within(lists, starts[ids], starts[ids + 1], lo, hi)
        upto = np.concatenate([[0], np.cumsum(b - a)])
        out, i = np.zeros(hi - lo, dtype=np.int64), 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + EXPANDED, "right")) - 1)
            got = lists[np.repeat(a[i:j] - (upto[i:j] - upto[i]), b[i:j] - a[i:j]) + np.arange(upto[j] - upto[i])]
            out += np.bincount(got[(got >= lo) & (got < hi)] - lo, minlength=hi - lo)
            i = j
        return out

    answers: list[tuple[np.ndarray, int, int, np.ndarray]] = []
    for i in sorted(range(len(queries)), key=lambda i: len(queries[i])):
        s = queries[i]
        n = len(s)
        lo, hi = int(np.searchsorted(sizes, -(-percent * n // 100))), int(np.searchsorted(sizes, 100 * n // percent, "right"))
        if not n or lo >= hi:
            continue
        where = np.searchsorted(tokens, s)
        where[where == len(tokens)] = 0
        ids = where[tokens[where] == s]
        if not len(ids):
            continue
        best, known = None, None
        work = int((starts[ids + 1] - starts[ids]).sum())
        if work > 4 * n + 200:  # common lists: see whether an answer can be reused
            for a in answers:
                if a[1] <= lo and a[2] >= hi:
                    both = len(np.intersect1d(ids, a[0], assume_unique=True))
                    cost = len(ids) + len(a[0]) - 2 * both
                    if cost < len(ids) // 2 and (best is None or cost < best):
                        best, known = cost, a
        if known is not None:
            less, more = np.setdiff1d(known[0], ids, True), np.setdiff1d(ids, known[0], True)
            found = known[3][lo - known[1] : hi - known[1]] - counts(less, lo, hi) + counts(more, lo, hi)
        else:
            wide = int(np.searchsorted(sizes, 100 * n * 5 // (percent * 4), "right"))
            low = int(np.searchsorted(sizes, percent * n * 4 // 500))
            low, wide = min(low, lo), max(wide, hi)
            full = counts(ids, low, wide)
            found = full[lo - low : hi - low]
            if work > 4 * n + 200:
                answers.append((ids, low, wide, full))
                del answers[:-ANSWERS]
        hits = np.flatnonzero(found >= least_overlap(n, sizes[lo:hi], percent)) + lo
        if len(hits):
            yield i, by_size[hits]


def _links(size: int, percent: int):
    """One task: queries (role 0 or 2) against indexed sets (role 1 or 2)."""

    def kernel(t: pa.Table) -> pa.Table:
        role, key, times = (t.column(x).to_numpy().copy() for x in ("role", "key", "times"))
        texts = unzipped(t.column("text"))
        # Rows of one doc_id may differ in text, or be the same: of each class and role one row stays.
        seen: set[tuple[int, int]] = set()
        for i, (k, r, s) in enumerate(zip(key.tolist(), role.tolist(), shingle_sets(texts, size), strict=True)):
            if (k, r) in seen or not len(s) or set_key(s) != k:
                role[i] = 9
            else:
                seen.add((k, r))
        keep = np.flatnonzero(role != 9)
        sets, role, key, times = exact_sets(texts.take(pa.array(keep)), size), role[keep], key[keep], times[keep]
        q, x = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        links = np.zeros(len(sets), dtype=np.int64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, hits in overlaps_join([sets[k] for k in q], [sets[k] for k in x], percent):
            me, others = key[q[i]], x[hits]
            others = others[key[others] != me]
            if len(others):
                links[q[i]] = times[others].sum()
                a.append(np.full(len(others), me))
                b.append(key[others])
                if len(a) > 2000:
                    n, r = c.roots(np.concatenate(a), np.concatenate(b))
                    a, b = [n], [r]
        n, r = c.roots(np.concatenate(a), np.concatenate(b))
        out = dict(zip(n.tolist(), r.tolist(), strict=True))
        for k in q:
            out.setdefault(int(key[k]), int(key[k]))
        count = dict(zip(key[q].tolist(), links[q].tolist(), strict=True))
        return pa.table({"key": pa.array(out.keys(), pa.int64()), "root": pa.array(out.values(), pa.int64()), "links": pa.array([count.get(k, 0) for k in out], pa.int64())})

    return kernel


NAMES = ["doc_id", "n", "key", "chunk", "bucket", "data"]
PROFILE = "doc_id long, n long, key long, chunk long, bucket long, data binary"


def _clusters(texts: DataFrame, total: int, size: int, percent: int, packed: bool) -> tuple[DataFrame | None, DataFrame]:
    """(doc_id, n, key) of all rows of texts, unless they are packed, and (key, cluster) of the classes that share a prefix shingle with one of
    a size that fits.  total: about how many shingles there are, which sets the number of buckets."""
    buckets = max(c.partitions(texts.sparkSession), total // BUCKET + 1)
    # So many bits tell nearly all shingles apart; two that are taken for one only make a cluster larger.
    bits = min(60, max(32, total.bit_length() + 8))
    cuts = edges(buckets, bits)
    profile = c.stored(c.map_arrow(texts, _chunks(size, bits, cuts, packed), PROFILE), "sets")
    tokens = profile.where("bucket >= 0").select("chunk", "bucket", "data").repartition(buckets, "bucket")
    counts = tokens.groupBy("bucket").applyInArrow(c.by_group(_counts(cuts)), "chunk long, bucket long, data binary")
    owners = profile.where("bucket = -1").select("chunk", "bucket", "data")
    prefixes = c.stored(owners.union(counts).groupBy("chunk").applyInArrow(c.by_group(_prefixes(percent, cuts)), "bucket long, postings binary, a long, b long"), "prefixes")
    postings = prefixes.where("bucket is not null").select("bucket", "postings").repartition(buckets, "bucket")
    stars = postings.groupBy("bucket").applyInArrow(c.by_group(_stars(percent)), "a long, b long")
    clusters = c.stored(c.components(stars.union(prefixes.where("bucket is null").select("a", "b"))).withColumnRenamed("node", "key").withColumnRenamed("root", "cluster"), "clusters")
    # Packed sets take as much room as the texts; of them only sizes and keys are still to be read.
    sets = None if packed else c.stored(profile.where("n is not null").select("doc_id", "n", "key"), "keys")
    c.dropped(profile)
    c.dropped(prefixes)
    return sets, clusters


def jaccard_join(docs: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs(doc_id, text).

    Two documents link when 100 |A and B| >= percent |A or B| over their sets of word n-grams of the given size.
    component_id is the smallest doc_id reachable by links, n_links the number of other rows linked directly.
    """
    spark = c.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A word of five bytes and a separator is short: this is about the number of words, or more.
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    sets, clusters = _clusters(docs, total, size, percent, packed=False)

    # One text of each class in a cluster: here no copies raise the counts, which then are exact, and prefixes tell more.
    classes = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"), F.first("n").alias("n"))
    members = classes.where("doc_id is not null").join(clusters.select("key"), "key")
    zipped = c.map_arrow(docs, _zip, "doc_id long, text binary")
    # Texts are streamed past a hash table of the members' ids, not sorted.
    near = zipped.join(members.hint("shuffle_hash"), "doc_id").select("key", "times", "n", "text")
    # A class of null ids alone has no id to find its text by: its texts are found by their sets.
    nameless = c.map_arrow(docs.where("doc_id is null").select("text"), _keyed(size), "key long, text binary").dropDuplicates(["key"])
    near = c.stored(near.union(nameless.join(classes.where("doc_id is null").join(clusters.select("key"), "key"), "key").select("key", "times", "n", "text")), "near")
    _, clusters = _clusters(near.select("key", "text"), near.agg(F.sum("n")).first()[0] or 0, size, percent, packed=True)

    clusters = clusters.join(classes.select("key", "n"), "key")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = c.stored(clusters.join(blocks, "cluster"), "members")
    tasks = max(c.partitions(spark), (members.agg(F.sum("n")).first()[0] or 0) // TOGETHER + 1)
    mine = F.pmod(F.xxhash64("key", F.lit(1)), "blocks").cast("int")
    rows = near.drop("n").join(members.hint("shuffle_hash"), "key")
    small = F.struct(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("home"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(2).alias("role"))
    as_query = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("cluster").alias("home"), mine.alias("i"), j.alias("j"), F.when(j == mine, 2).otherwise(0).alias("role")))
    as_indexed = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != mine), lambda i: F.struct(F.col("cluster").alias("home"), i.alias("i"), mine.alias("j"), F.lit(1).alias("role")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("blocks") == 1, F.array(small)).otherwise(F.concat(as_query, as_indexed))))
    rows = rows.select("at.home", "at.i", "at.j", "at.role", "key", "times", "text")
    found = c.stored(rows.groupBy("home", "i", "j").applyInArrow(c.by_group(_links(size, percent)), "key long, root long, links long"), "links")
    c.dropped(near)
    c.dropped(members)

    reached = c.components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    # From classes to documents: a component's smallest doc_id; rows of one doc_id but different texts are one node.
    named = classes.join(reached, "key", "left").withColumn("root", F.coalesce("root", "key")).join(counts, "key", "left")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("key", "component_id", "times", F.coalesce("links", F.lit(0)).alias("links"))
    out = sets.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("key").isNull(), 0).otherwise(F.col("links") + F.col("times") - 1).cast("long").alias("n_links"))
