"""Packing documents into sequences of a fixed number of tokens.

1. Each document's token ids, ended by id 0, are cut into pieces of `capacity` tokens.  Runs of letters, digits and runs of
   other characters are tokenized once per worker: the tokenizer splits there itself, so ids of runs joined are the ids of
   the text.
2. Only counts of lengths, at most `capacity` rows, come to the driver.  Martello and Toth's dominance reduction fixes
   sets of up to three lengths that are at least as good as any other set with their largest piece; the rest is packed
   by best fit, largest first.  Both work on counts: a pattern of lengths is used many times.
3. Pieces are ranked within their length, by task and by place in the task, and ranks are looked up in the patterns.

A length of any number of pieces is counted before it is shuffled and ranked by task; the patterns' size is bounded by
capacity, not by the documents.  Null text is empty and becomes a piece of the single id 0; a text of any length is cut
into pieces; repeated rows are documents of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import common as c

#: Longest run kept, and runs kept, by a worker's memory of tokenized runs.
RUN_BYTES, RUNS = 48, 1_500_000

#: What a byte is to the tokenizer: white space, a letter, a digit, of any other kind, or not told by the byte.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, dtype=np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[ord("'")] = ODD  # it may begin a suffix
KIND[c.SEPARATOR] = SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_loaded: dict[str, "Words"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, first run of each text) of what the tokenizer takes apart before all else: runs of letters, digits,
    and runs of other characters, in lower case.

    That holds for words of ASCII and the letters U+00C0 to U+00FF.  A word that has other characters, an apostrophe or
    what may be a special token is one run, as it is.
    """
    kind, low = KIND[data], LOWER[data]
    edge = at[:-1][at[:-1] < at[1:]]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        after = data[lead + 1]
        good = (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[good], after[good]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead[after < 0x9F] + 1] += 0x20
    token = np.flatnonzero(data[:-1] == ord("<"))
    kind[token[data[token + 1] == ord("|")]] = ODD
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        inside = kind != SPACE
        ends = ~inside
        ends[edge] = True  # a word that another text follows ends there
        stops = np.append(np.flatnonzero(ends), len(data))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edge] = inside[edge]
        begins = np.flatnonzero(begins)
        a = begins[np.unique(np.searchsorted(begins, odd, "right") - 1)]
        n = stops[np.searchsorted(stops, a, "right")] - a
        whole = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kind[whole], low[whole] = ODD, data[whole]
    new = kind == DIGIT
    new[1:] |= kind[1:] != kind[:-1]
    new[edge] = True
    cuts = np.flatnonzero(new)
    held = kind[cuts] != SPACE
    offsets = np.zeros(np.count_nonzero(held) + 1, dtype=np.int64)
    np.cumsum(np.diff(np.append(cuts, len(data)))[held], out=offsets[1:])
    return low[kind != SPACE], offsets, np.searchsorted(cuts[held], at)


class Words:
    """A tokenizer's ids of runs, remembered.

    The ids of runs, joined, are the ids of the text.  New runs of letters are tokenized in one text and told apart by the
    ids that end a run; if their number is not that of the runs, and for all other runs, each is tokenized alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Where the ids of run k begin and end, at k and k + 1, and the ids; both arrays have room behind.
        self.at, self.flat = np.zeros(1, dtype=np.int64), np.empty(0, dtype="<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The runs in another order, how many ids each has, and the ids."""
        letters: list[str] = []
        other: list[str] = []
        for w in map(bytes.decode, new):
            (letters if w.isalpha() else other).append(w)
        sizes, ids = [], []
        for i in range(0, len(letters), 2000):
            part = letters[i : i + 2000]
            (got,) = self.encode([" ".join(part)])
            at = np.flatnonzero(self.ends[got]) + 1
            if len(at) == len(part) and at[-1] == len(got):
                sizes.append(np.diff(at, prepend=0))
                ids.append(got)
            else:
                other += part
                letters[i : i + 2000] = [""] * len(part)
        alone = self.encode(other)
        sizes.append(np.array([len(x) for x in alone], dtype=np.int64))
        return [w.encode() for w in letters if w] + [w.encode() for w in other], np.concatenate(sizes), np.concatenate([*ids, *alone])

    def remember(self, new: list[bytes]) -> None:
        order, sizes, ids = self.learn(new)
        n = len(self.known)
        used = int(self.at[n])
        self.flat = put(self.flat, used, ids)
        self.at = put(self.at, n + 1, used + np.cumsum(sizes))
        self.known.update(zip(order, range(n, n + len(order)), strict=True))

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """The place of each of the runs in the memory; those it lacks are tokenized, the long ones last."""
        out = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), dtype=np.int64, count=len(distinct))
        lacking = np.flatnonzero(out < 0)
        if len(self.known) + len(lacking) > RUNS:
            self.forget()
            lacking = np.arange(len(distinct))
        new = [distinct[k] for k in lacking.tolist()]
        for part in ([w for w in new if len(w) <= RUN_BYTES], [w for w in new if len(w) > RUN_BYTES]):
            if part:
                self.remember(part)
        out[lacking] = [self.known[w] for w in new]
        return out

    def ids(self, data: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
        """The ids of each text data[at[k] : at[k + 1]], as little-endian 32-bit integers."""
        held, offsets, first = runs(data, at)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        distinct = column.dictionary.to_pylist()
        number = self.numbers(distinct)[column.indices.to_numpy()]
        n = self.at[number + 1] - self.at[number]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.at[number] - (ends - n), n) + np.arange(n.sum())].tobytes()
        bounds = (4 * np.append(0, ends)[first]).tolist()
        for w in distinct:
            if len(w) > RUN_BYTES:  # these came last, so room is taken up again
                del self.known[w]
        for x, y in itertools.pairwise(bounds):
            yield out[x:y]


def put(array: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """array with `new` behind its first `used` values, in twice the room where there was too little."""
    if used + len(new) > len(array):
        array = np.concatenate([array[:used], np.empty(max(used, len(new)), array.dtype)])
    array[used : used + len(new)] = new
    return array


def tokenizer(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    c.KEPT[__name__] = _loaded.clear
    return _loaded[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long, ids binary"


def _pieces(capacity: int, path: str, keep_ids: bool):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, placed = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            data, at = c.utf8(b.column(1))
            for i, j in c.slices(at):
                rows = []
                for k, ids in zip(range(i, j), tokenizer(path).ids(data[at[i] : at[j]], at[i : j + 1] - at[i]), strict=True):
                    ids += b"\0\0\0\0"
                    id_ = b.column(0)[k].as_py()
                    for n, x in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[x : x + 4 * capacity]
                        length = len(part) // 4
                        rows.append((id_, n, x // 4, length, zlib.crc32(part), task, placed[length], part if keep_ids else None))
                        placed[length] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return kernel


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed (lengths of a sequence, times), and the counts that are left.

    With s the largest piece and r the room beside it: a single piece of length r, or the largest that fits where no two
    fit, dominates; where no three fit, so does the largest if no pair is longer, and the largest with its best partner
    if no pair has a longer smaller part.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        need = {k: lengths.count(k) for k in lengths}
        times = min(left[k] // n for k, n in need.items())
        fixed.append((lengths, times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]

    def smallest(n: int) -> list[int]:
        out: list[int] = []
        for k in sorted(left):
            out += [k] * min(n - len(out), left[k])
            if len(out) == n:
                break
        return out

    for s in sorted(left, reverse=True):
        while left.get(s):
            left[s] -= 1  # what may stand beside one of them
            others = sorted(k for k in left if left[k] > 0)
            room = capacity - s
            low = smallest(3)
            left[s] += 1
            fits = others[: bisect.bisect_right(others, room)]
            if not fits:
                take(s)
                continue
            k = fits[-1]
            if k == room or len(low) < 2 or low[0] + low[1] > room:
                if k == s and left[s] < 2:
                    break
                take(s, k)
                continue
            if len(low) == 3 and sum(low) <= room:
                break
            spare = {x: left[x] - (x == s) for x in fits}
            best_pair, best_small = 0, 0
            for x in fits:
                y = bisect.bisect_right(fits, min(room - x, x)) - 1
                while y >= 0 and fits[y] == x and spare[x] < 2:
                    y -= 1
                if y >= 0:
                    best_pair, best_small = max(best_pair, x + fits[y]), max(best_small, fits[y])
            if best_pair <= k:
                take(s, k)
                continue
            y = bisect.bisect_right(fits, room - k) - 1
            while y >= 0 and fits[y] == k and spare[k] < 2:
                y -= 1
            if y >= 0 and best_small <= fits[y]:
                if any((s, k, fits[y]).count(x) > left[x] for x in (s, k, fits[y])):
                    break
                take(s, k, fits[y])
                continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first: (lengths of a sequence, times)."""
    rooms: list[int] = []
    at: dict[int, list[list]] = {}

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in at:
            bisect.insort(rooms, room)
            at[room] = []
        at[room].append([lengths, times])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                if n >= each:
                    put(capacity - each * s, (s,) * each, n // each)
                if n % each:
                    put(capacity - n % each * s, (s,) * (n % each), 1)
                break
            room = rooms[i]
            lengths, times = at[room][-1]
            used = min(n, times)
            if used == times:
                at[room].pop()
                if not at[room]:
                    del at[room], rooms[i]
            else:
                at[room][-1][1] -= used
            put(room - s, (*lengths, s), used)
            n -= used
    return [(lengths, times) for kinds in at.values() for lengths, times in kinds]


def layout(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where pieces go: from rank `rank` of a length on, to sequences from `sequence` on, at `offset`."""
    fixed, left = reduce_by_dominance(counts, capacity)
    slots, used, sequence = [], defaultdict(int), 0
    for lengths, times in fixed + best_fit(left, capacity):
        offset = 0
        for s in lengths:
            slots.append((s, used[s], sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    out = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
    return {"length": out[:, 0], "rank": out[:, 1], "sequence": out[:, 2], "offset": out[:, 3], "sequences": np.int64(sequence)}


def _place(plan: dict[str, np.ndarray]):
    key = plan["length"] << 48 | plan["rank"]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length << 48 | rank, "right") - 1
            columns = [*b.drop_columns(["rank"]).columns, pa.array(plan["sequence"][i] + rank - plan["rank"][i]), pa.array(plan["offset"][i])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return kernel


def pack(docs: DataFrame, *, capacity: int = 2048, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece of docs(doc_id, text).

    path: the tokenizer's file, at the same place on every machine.  keep_ids: return the ids, as 32-bit integers.
    """
    path = path or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = c.stored(c.map_arrow(docs, _pieces(capacity, path, keep_ids), PIECE), "pieces")
    counts = c.stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    plan = layout({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead.hint("shuffle_hash"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("ahead") + F.col("place")).alias("rank"))
    return c.map_arrow(ranked, _place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
