"""Exact removal of repeated passages: every byte inside a string of `length` bytes that also starts earlier.

1. Texts are laid out in chunks of bytes, a table bucketed by chunk.  Each window of `length` bytes belongs to the
   smallest hash among its GRAM-byte grams; a run of windows with the same gram is one stretch.  What a window belongs to
   depends on its bytes alone, so equal windows lie at the same place of stretches with the same gram.
2. Hashes of (gram, stretch), one of each per chunk, meet in buckets of grams.  Every stretch but the first of equal ones
   is repeated as a whole.  A window has the half of its other bytes before its gram, or behind it; two kinds of stretch
   with a window in common have the bytes of that half in common, and hashes of these tell which sides of first stretches
   to compare, and with which others.  Only those sides go on as bytes, each to the bucket of its gram and half, so
   stretches of one common gram part by their halves; of equal sides in a chunk only the first goes.
3. Those are joined into one text per bucket, with a suffix array by prefix doubling.  Threshold-bounded interval
   expansion on its Burrows-Wheeler transform gives the common prefixes by increasing value: a queue holds the intervals
   of strings of l bytes, each is extended to the left by every byte before it, and where a new interval ends without a
   boundary there is one of value l, and that interval is queued; all stops at `length`, up to which alone the array is in
   order.  What is left without a boundary are the intervals of equal windows; all but the earliest window of an interval
   are repeated.
4. Ranges return to their chunks, where the bytes are cut out.

Memory: a task holds one chunk, or one bucket of hashes or of sides.  A passage that stands in a third of all texts is
sent once per chunk.  Equal stretches are told by a 40-bit hash of their gram and two 64-bit hashes of their bytes, not
byte for byte.  Order is by doc_id, null last; rows that share a doc_id come in the order of the input.  Null text is
empty; a text shorter than `length` keeps all its bytes, and one of any length is taken whole; an empty table gives no
rows; other columns are ignored, or carried along whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logweave.llm import common as c

#: Bytes of a gram, of a chunk, of the stretches in a bucket; hashes in a bucket; bytes hashed at once, whose arrays stay in a core's cache.
GRAM, CHUNK, STRETCHES, HASHES, CACHED = 24, 4 << 20, 1 << 17, 500_000, 1 << 15
NULL_ID = np.iinfo(np.int64).max
#: A second number of 64 bits for each byte value.
OTHER = c.mix(c.BYTES ^ np.uint64(0x2545F4914F6CDD1D))
#: What becomes of a stretch: nothing, all of it is repeated, or its windows with more before or behind the gram are compared.
WHOLE, BEFORE, BEHIND = 1, 2, 4


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text, carried columns), gathered; the carried columns travel as an Arrow stream."""
    part, at = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    texts: list[bytes] = []
    rest: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        nonlocal at
        id_ = np.concatenate(ids)
        order = np.argsort(id_, kind="stable")
        lens = np.array([len(texts[i]) for i in order], dtype=np.int64)
        carried = pa.Table.from_batches(rest).take(pa.array(order)) if rest else None
        out = pa.BufferOutputStream()
        if carried is not None:
            with pa.ipc.new_stream(out, carried.schema) as w:
                w.write_table(carried)
        values = [id_[order].tobytes(), lens.tobytes(), b"".join(texts[i] for i in order), out.getvalue().to_pybytes()]
        row = pa.RecordBatch.from_arrays([pa.array([part << 32 | at]), *(pa.array([v], pa.binary()) for v in values)], names=["chunk", "ids", "lengths", "bytes", "carried"])
        at += 1
        ids.clear()
        texts.clear()
        rest.clear()
        return row

    held = 0
    for b in batches:
        id_ = b.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        data, at_ = c.utf8(b.column(1))
        for i, j in c.slices(at_, CHUNK // 4):
            ids.append(id_[i:j])
            texts += [data[at_[k] : at_[k + 1]].tobytes() for k in range(i, j)]
            if b.num_columns > 2:
                rest.append(b.slice(i, j - i).drop_columns(b.schema.names[:2]))
            held += int(at_[j] - at_[i])
            if held >= CHUNK:
                held = 0
                yield flush()
    if texts:
        yield flush()


def chunk_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, n + 1 offsets, bytes) of a chunk's row."""
    ids, lens, data = (t.column(x)[0].as_buffer() for x in ("ids", "lengths", "bytes"))
    return np.frombuffer(ids, np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(lens, np.int64))]), np.frombuffer(data, np.uint8)


def stretches(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, hash, first window, last window, hash before, hash after, where the gram begins, second hash) of every stretch.

    Windows are named by their first byte; the hashes before and after the gram are 0 where the stretch ends too early.
    """
    out: list[tuple] = []
    span, half = length - GRAM + 1, (length - GRAM + 1) // 2
    slice_ = max(CACHED, min(8 * length, c.SLICE))
    for lo in range(0, max(len(data) - length + 1, 0), slice_):
        d = data[lo : lo + slice_ + length - 1]
        s, s2 = c.prefix_sums(d, c.BYTES), c.prefix_sums(d, OTHER)
        inverse = c.powers(len(d) + 1)[1]
        h = c.mix((s[GRAM:] - s[:-GRAM]) * inverse[: len(d) - GRAM + 1])
        h = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < span:
            step = min(have, span - have)
            h = np.minimum(h[:-step], h[step:])
            have += step
        n = len(h)
        edge = np.zeros(n + 1, dtype=np.int32)
        here = at[max(np.searchsorted(at, lo, "right") - 1, 0) : np.searchsorted(at, lo + n) + 1] - lo
        whole = here[1:] - here[:-1] >= length
        np.add.at(edge, np.clip(here[:-1][whole], 0, n), 1)
        np.add.at(edge, np.clip(here[1:][whole] - length + 1, 0, n), -1)
        valid = np.cumsum(edge[:-1]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (h[1:] != h[:-1])
        end = valid.copy()
        end[:-1] &= ~valid[1:] | (h[1:] != h[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        p = (h[a] & np.uint64(0xFFFFFF)).astype(np.int64)
        v = (s[b + length] - s[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (p - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        w = (s2[b + length] - s2[a]) * inverse[a]
        x, y = np.maximum(p - half, a), np.minimum(p + GRAM + half, b + length)
        before = np.where(p - half >= a, c.mix((s[p] - s[x]) * inverse[x]) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        after = np.where(p + GRAM + half <= b + length, c.mix((s[y] - s[p + GRAM]) * inverse[p + GRAM]) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        out.append((h[a] >> np.uint64(24), c.mix(v), a + lo, b + lo, before.astype(np.uint32), after.astype(np.uint32), p + lo, c.mix(w)))
    types = (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.int64, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, t) for t in types)


def first_of_chunk(gram: np.ndarray, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether a stretch is the first of its kind in its chunk."""
    first = np.ones(len(h), dtype=bool)
    some = shared(h)
    order = some[np.lexsort((some, h2[some], h[some], gram[some]))]
    first[order] = new_runs(gram[order], h[order], h2[order])
    return first


def shared(key: np.ndarray) -> np.ndarray:
    """Where values stand that stand elsewhere too."""
    order = np.argsort(key)
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out = np.zeros(len(key), dtype=bool)
    out[order[again]] = out[order[again + 1]] = True
    return np.flatnonzero(out)


def new_runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def by_bucket(gram: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    bucket = (c.mix(gram + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, cut = np.unique(bucket[order], return_index=True)
    return list(zip(ids.tolist(), np.split(order, cut[1:]), strict=True)) if len(ids) else []


def _hashes(length: int, buckets: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(k, 1)])
                ids, at, data = chunk_of(t)
                gram, h, a, _, before, after, _, h2 = stretches(data, at, length)
                first = np.flatnonzero(first_of_chunk(gram, h, h2))
                row = np.searchsorted(at, a[first], "right") - 1
                parts = by_bucket(gram[first], buckets)
                rows = [c.pack(gram[first[i]], h[first[i]], h2[first[i]], ids[row[i]], a[first[i]].astype(np.uint32), before[first[i]], after[first[i]]) for _, i in parts]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in parts], pa.int64()), pa.array([t.column("chunk")[0].as_py()] * len(parts), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "chunk", "hashes"])

    return kernel


def _statuses(t: pa.Table) -> pa.Table:
    """For each stretch of a bucket what becomes of it: a later one of a kind is repeated as a whole, and the first of a kind
    has the sides compared that another kind has too."""
    chunk = t.column("chunk").to_numpy()
    parts = [c.unpack(x.as_py(), np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.uint32) for x in t.column("hashes")]
    lens = np.array([len(p[0]) for p in parts])
    gram, h, h2, id_, a, before, after = (np.concatenate([p[k] for p in parts]) for k in range(7))
    some = shared(h)
    order = some[np.lexsort((a[some], np.repeat(chunk, lens)[some], id_[some], h2[some], h[some], gram[some]))]
    status = np.zeros(len(gram), np.uint8)
    status[order[~new_runs(gram[order], h[order], h2[order])]] = WHOLE
    for bit, side in ((BEFORE, before), (BEHIND, after)):
        kinds = np.flatnonzero((status != WHOLE) & (side > 0))
        status[kinds[shared(c.mix(c.mix(gram[kinds]) + side[kinds]))]] |= np.uint8(bit)
    out = np.split(status, np.cumsum(lens)[:-1])
    keep = [i for i, s in enumerate(out) if s.any()]
    return pa.table({"chunk": pa.array(chunk[keep], pa.int64()), "bucket": pa.array([t.column("bucket")[0].as_py()] * len(keep), pa.int64()), "status": pa.array([c.pack(out[i]) for i in keep], pa.binary())})


def _resolve(length: int, buckets: int, groups: int):
    """From a chunk and its statuses: kind 0, the byte ranges repeated as whole stretches; kind 1, the sides to compare."""
    half = (length - GRAM + 1) // 2

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"kind": [], "place": [], "data": []}
        if left.num_rows:
            ids, at, data = chunk_of(left)
            chunk = left.column("chunk")[0].as_py()
            gram, h, a, b, before, after, p, h2 = stretches(data, at, length)
            first = first_of_chunk(gram, h, h2)
            status = np.full(len(gram), WHOLE, np.uint8)
            status[first] = 0
            told = dict(zip(right.column("bucket").to_pylist(), right.column("status").to_pylist(), strict=True))
            where = np.flatnonzero(first)
            for bucket, i in by_bucket(gram[where], buckets):
                if bucket in told:
                    status[where[i]] = c.unpack(told[bucket], np.uint8)[0]
            # Windows with at least half of the other bytes before the gram, and the others.
            x, y = np.flatnonzero(status & BEFORE), np.flatnonzero(status & BEHIND)
            key = np.concatenate([c.mix(c.mix(gram[x]) + before[x]), c.mix(c.mix(gram[y]) + after[y]) + np.uint64(1)])
            begin, end = np.concatenate([a[x], np.maximum(a[y], p[y] - half + 1)]), np.concatenate([np.minimum(b[x], p[x] - half), b[y]])
            some = begin <= end
            key, begin, end = key[some], begin[some], end[some]
            texts = [data[i:j].tobytes() for i, j in zip(begin.tolist(), (end + length).tolist(), strict=True)]
            # Of equal sides the first goes: in order of place, which is that of the documents.
            seen: set[tuple[int, bytes]] = set()
            again = np.zeros(len(key), dtype=bool)
            for i in np.argsort(begin, kind="stable").tolist():
                kind = (int(key[i]), texts[i])
                again[i] = kind in seen
                seen.add(kind)
            whole = status == WHOLE
            gone = merged(np.concatenate([a[whole], begin[again]]), np.concatenate([b[whole], end[again]]) + length)
            if len(gone[0]):
                out["kind"].append(0)
                out["place"].append(chunk)
                out["data"].append(c.pack(*gone))
            where = np.flatnonzero(~again)
            row = np.searchsorted(at, begin[where], "right") - 1
            for group, i in by_bucket(key[where], groups):
                w = where[i]
                head = c.pack(ids[row[i]], begin[w], (end[w] - begin[w]).astype(np.uint32))
                out["kind"].append(1)
                out["place"].append(group)
                out["data"].append(len(head).to_bytes(8, "little") + chunk.to_bytes(8, "little") + head + zstandard.compress(b"".join(texts[k] for k in w.tolist()), 1))
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "place": pa.array(out["place"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    return kernel


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges [a, b), with those that touch or overlap joined."""
    if not len(a):
        return a.astype(np.int64), b.astype(np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at].astype(np.int64), b[np.append(at[1:], len(a)) - 1].astype(np.int64)


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions in order of what stands from there to the next 0, by prefix doubling; equal ones in order of place.

    text: symbols below 512, with a 0 at the end of each of its parts.  depth: symbols up to which the order is needed.
    """
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    zeros = np.flatnonzero(text == 0)
    left = np.repeat(zeros, np.diff(zeros, prepend=-1)) - np.arange(n)  # symbols up to the next 0
    number = np.cumsum(np.bincount(text, minlength=512) > 0) - 1  # fewer bits, more symbols in a key
    width, bits = max(int(number[-1]).bit_length(), 1), n.bit_length()
    have = max((63 - bits) // width, 1)
    padded = np.concatenate([number[text], np.zeros(have, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(have):
        key = key << width | np.where(left >= k, padded[k : k + n], 0)
    longest = int(left.max()) + 1
    enough = longest if depth is None else min(longest, depth)
    rank, order = ranks(key, bits)
    while have < enough and rank[order[-1]] < n:
        later = np.zeros(n, dtype=np.int64)
        later[: n - have] = np.where(left[: n - have] >= have, rank[have:], 0)
        rank, order = ranks(rank * (n + 1) + later, bits)
        have *= 2
    return order


def ranks(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key from 1 on, the places in order of key and place); places have so many bits."""
    if int(key.max()).bit_length() + bits <= 63:
        # Sorting values takes a fraction of the time of sorting places by them.
        both = key << bits | np.arange(len(key))
        both.sort()
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new_runs(key))
    return rank, order


def equal_prefixes(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix array, whether it begins an interval of suffixes that share their first `length` symbols.

    Intervals of strings of l symbols are extended to the left by each symbol of the Burrows-Wheeler transform in them.
    The rows of an extended string are again an interval; if no boundary is known where it ends, that one has value l, and
    the interval is queued for l + 1.  Every boundary is found once, in order of value; those of `length` and more never are.
    """
    n = len(sa)
    kind = np.int32 if n < 1 << 31 else np.int64
    transform = text[sa - 1]
    # The rows whose suffixes are longer by the symbol before: among rows of one symbol the order stays.
    order = np.argsort(transform, kind="stable").astype(kind)
    longer = np.empty(n, dtype=kind)
    longer[order] = np.arange(n, dtype=kind)
    # The rows of the same symbol before and behind a row: those outside an interval tell where an extended string's rows end.
    same = np.flatnonzero(~new_runs(transform[order]))
    before, behind = np.full(n, -1, dtype=kind), np.full(n, n, dtype=kind)
    before[order[same]], behind[order[same - 1]] = order[same - 1], order[same]
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    low, high = np.zeros(1, dtype=kind), np.full(1, n, dtype=kind)
    for value in range(length):
        if value == 1:  # no string goes on beyond an end
            ends = transform == 0
            before[ends], behind[ends] = n, -1
        size = (high - low).astype(np.int64)
        if not len(size):
            break
        rows = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        first, last = rows[before[rows] < np.repeat(low, size)], rows[behind[rows] >= np.repeat(high, size)]
        low, high = np.sort(longer[first]), np.sort(longer[last]) + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known[:n]


def _compare(length: int):
    def kernel(t: pa.Table) -> pa.Table:
        chunk, id_, a, runs, texts = [], [], [], [], []
        for x in t.column("data"):
            x = x.as_py()
            size = int.from_bytes(x[:8], "little")
            i, start, run = c.unpack(x[16 : 16 + size], np.int64, np.int64, np.uint32)
            body = zstandard.decompress(x[16 + size :], max_output_size=1 << 31)
            lens = run.astype(np.int64) + length
            cut = np.concatenate([[0], np.cumsum(lens)])
            texts += [body[p:q] for p, q in zip(cut[:-1], cut[1:], strict=True)]
            chunk.append(np.full(len(i), int.from_bytes(x[8:16], "little")))
            id_.append(i)
            a.append(start)
            runs.append(lens)
        chunk, id_, a, lens = (np.concatenate(x) for x in (chunk, id_, a, runs))
        order = np.lexsort((a, chunk, id_))  # places in the joined text then follow the order of the documents
        chunk, a, lens = chunk[order], a[order], lens[order]
        starts = np.concatenate([[0], np.cumsum(lens + 1)])
        text = np.frombuffer(b"".join(texts[i] + b"\0" for i in order), np.uint8).astype(np.int16) + 1
        text[starts[1:] - 1] = 0
        sa = suffix_array(text, length)
        interval = np.cumsum(equal_prefixes(text, sa, length)) - 1
        owner = np.repeat(np.arange(len(lens)), lens + 1)
        valid = np.arange(len(text)) + length < starts[owner + 1]
        ok = valid[sa]
        sa, interval = sa[ok], interval[ok]
        new = np.ones(len(sa), bool)
        new[1:] = interval[1:] != interval[:-1]
        first = np.minimum.reduceat(sa, np.flatnonzero(new)) if len(sa) else sa
        again = np.sort(sa[sa != first[np.cumsum(new) - 1]])
        who = owner[again]
        begin = a[who] + again - starts[who]
        out: dict[str, list] = {"place": [], "data": []}
        for k in np.unique(chunk[who]):
            mine = begin[chunk[who] == k]
            out["place"].append(int(k))
            out["data"].append(c.pack(*merged(mine, mine + length)))
        return pa.table({"place": pa.array(out["place"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    return kernel


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return CUT.empty_table()
    ids, at, data = chunk_of(left)
    gone = [c.unpack(x.as_py(), np.int64, np.int64) for x in right.column("data")]
    a, b = merged(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*gone, strict=True) if gone else ((), ()))))
    covered = np.concatenate([[0], np.cumsum(b - a)])
    # The bytes gone before each place where a text begins or ends: of the ranges that begin before, less what lies behind.
    begun = np.searchsorted(a, at)
    before = covered[begun] - np.where(begun > 0, np.maximum(b[begun - 1] - at, 0) if len(b) else 0, 0)
    n_gone = np.diff(before)
    n_spans = np.where(np.diff(at) > 0, begun[1:] - np.searchsorted(b, at[:-1], "right"), 0)
    bytes_ = memoryview(data)
    kept = b"".join([bytes_[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)])
    ends = at - before
    texts = [kept[i:j] for i, j in itertools.pairwise(ends.tolist())]
    columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(np.diff(at)), pa.array(n_gone.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(texts, pa.binary())]
    return pa.table(columns, names=CUT.names).cast(CUT)


def _cut_rows(schema: pa.Schema):
    """As _cut, but with the carried columns beside the kept text; fragments of cut characters go."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        cut = _cut(left, right)
        with pa.ipc.open_stream(left.column("carried")[0].as_buffer()) as r:
            carried = r.read_all()
        text = pa.array([x.as_py().decode(errors="ignore") for x in cut.column("kept")])
        return pa.table([cut.column("doc_id"), text, *carried.columns], schema=schema)

    return kernel


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _ranges(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The chunks, and (place, data): the byte ranges to remove by chunk."""
    spark = c.prepare(docs.sparkSession)
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    least = c.partitions(spark)
    name = f"logweave_chunks_{uuid.uuid4().hex}"
    # Bucketed, so that the two later passes over the bytes read them where they are and shuffle small columns only.
    rows = c.map_arrow(docs, _chunks, "chunk long, ids binary, lengths binary, bytes binary, carried binary")
    rows.write.format("parquet").option("compression", "zstd").bucketBy(least, "chunk").saveAsTable(name)
    c.tables.add(name)
    chunks = spark.table(name)
    size = chunks.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(least, size * 2 // (length - GRAM + 2) // HASHES + 1)
    bare = chunks.drop("carried")
    hashes = c.map_arrow(bare, _hashes(length, buckets), "bucket long, chunk long, hashes binary")
    statuses = hashes.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(c.by_group(_statuses), "chunk long, bucket long, status binary")
    groups = max(least, size // 16 // STRETCHES + 1)  # arrays of so few bytes stay in a core's cache
    resolve = _resolve(length, buckets, groups)
    told = c.stored(bare.groupBy("chunk").cogroup(statuses.groupBy("chunk")).applyInArrow(c.by_cogroup(resolve), "kind int, place long, data binary"), "ranges")
    compared = told.where("kind = 1").repartition(groups, "place").groupBy("place").applyInArrow(c.by_group(_compare(length)), "place long, data binary")
    return chunks, told.where("kind = 0").select("place", "data").union(compared)


def remove_repeats(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs(doc_id, text); kept holds the bytes that stay."""
    chunks, ranges = _ranges(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return chunks.drop("carried").groupBy("chunk").cogroup(ranges.groupBy("place")).applyInArrow(c.by_cogroup(_cut), schema)


def without_repeats(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """docs, of any columns, with the repeats cut out of text."""
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    chunks, ranges = _ranges(rows, length)
    cut = _cut_rows(to_arrow_schema(rows.schema))
    return chunks.groupBy("chunk").cogroup(ranges.groupBy("place")).applyInArrow(c.by_cogroup(cut), rows.schema).select(*docs.columns)
