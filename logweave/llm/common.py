"""What the operators share: intermediate tables, byte hashing in numpy, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes at which words end: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"

#: Large texts are hashed in slices of so many bytes, which bounds a worker's memory.
SLICE = 1 << 20
#: Rows of an Arrow batch, at most.
BATCH = 2000
BASE = 0x9E3779B97F4A7C15 | 1


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    # Arrow batches of long texts are large; fewer rows in each bound what a task holds.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of this process, if all of Spark runs in it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="logweave-")
        atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Intermediate tables of this process that still stand.
_written: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage is cut, and it outlives executors."""
    spark = prepare(df.sparkSession)
    path = f"{shared_folder(spark)}/logweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.add(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, wherever the shared folder is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def dropped(df: DataFrame) -> None:
    """Delete the table that stored() gave, once nothing is going to read it."""
    for path in [x for x in _written if any(x in f for f in df.inputFiles())]:
        remove(df.sparkSession, path)


#: Managed tables of this process that still stand.
tables: set[str] = set()


def written() -> set[str]:
    """The intermediate tables of this process that stand now."""
    return _written | tables


def clear(spark: SparkSession, *, keep: DataFrame | None = None, before: set[str] = frozenset()) -> None:
    """Delete the intermediate tables of this process, but that of `keep` and those written `before`; results that read the
    others must have been written."""
    files = keep.inputFiles() if keep is not None else []
    for path in _written - before:
        if not any(path in f for f in files):
            remove(spark, path)
    for name in tables - before:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tables.discard(name)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Narrow rows that one task takes on with ease.
ROWS = 200_000


def in_tasks(rows: int) -> int:
    """Into how many tasks so many narrow rows go: coalesced to these, small tables are not cut into ever smaller files."""
    return rows // ROWS + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A number of 64 bits for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2**64, and those of its inverse."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size, out = max(n, SLICE + 4096), []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(1, dtype=np.uint64)
            step = base
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step % (1 << 64)
            out.append(p[:size])
        have = _powers[0] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with S[0] = 0, so that (S[j] - S[i]) * inverse[i] is a hash of data[i:j] wherever it stands."""
    s = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=s[1:])
    return s


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word.  data: the texts' bytes, end to end; starts: where each begins; A-Z is lower-cased."""
    a, b = word_bounds(data, starts)
    out = np.empty(len(a), dtype=np.uint64)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(b, a[i] + SLICE, "right")))
        out[i:j] = _word_hashes(data, a[i:j], b[i:j])
        i = j
    return out, np.searchsorted(starts, a, "right") - 1


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts[starts < len(data)]] = True
    edge[-1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _word_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each word data[a:b], the sum of numbers that stand for a byte at its place in the word.

    A byte's number depends on its place through a mix, so no pattern of bytes cancels out, as powers of a base would.
    """
    lo, hi = int(a[0]), int(b[-1])
    h = LOWER[data[lo:hi]]
    place = np.arange(lo, hi, dtype=np.uint64)
    place -= np.repeat(a.astype(np.uint64), np.diff(np.append(a, hi)))
    place *= np.uint64(0xA0761D6478BD642F)
    h ^= place
    del place
    shifted = np.empty_like(h)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(h, np.uint64(shift), out=shifted)
        h ^= shifted
        h *= np.uint64(factor)
    np.right_shift(h, np.uint64(31), out=shifted)
    h ^= shifted
    total = np.empty(len(h) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(h, out=total[1:])
    return mix(total[b - lo] - total[a - lo] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 places where texts begin and end; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, which compress well."""
    n = len(arrays[0])
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(n, -1).T).tobytes() for x in arrays), 1) if n else zstandard.compress((0).to_bytes(8, "little"), 1)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    data = zstandard.decompress(data, max_output_size=1 << 31)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


# ---------------------------------------------------------------- graphs


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, and for each the smallest node that links lead to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: tuple[np.ndarray, np.ndarray] | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        n, r = roots(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return n[n != r], r[n != r]

    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(x[0]) for x in held) > 1_000_000:
            have = fold()
            held = [have]
    if held:
        a, r = fold()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64())], names=["a", "b"])


#: A key with more than this part of all rows is joined by broadcast: there are fewer than PARTS of them.
PARTS = 4096
#: Bytes up to which a counted table is broadcast.
BROADCAST = 8 << 20


def attach(rows: DataFrame, values: DataFrame, key: str, *, salt: list[str] | None = None, width: int = 64) -> DataFrame:
    """rows, left-joined to the other columns of values, which holds each key once, and as n the number of its rows.

    Keys of more than one in PARTS rows, of which there are fewer than PARTS, come by broadcast, and their rows are then
    dealt by a hash of the salt columns (all, unless named), as are those of a null key; all other keys are small.  Where
    there are so few values, of about `width` bytes, that all can be broadcast, nothing is dealt.
    """
    total, count = values.agg(F.sum("n"), F.count("*")).first()
    names = [x for x in values.columns if x not in (key, "n")]
    if count * width <= BROADCAST:
        few = values.select(F.col(key).alias("few_"), *[F.col(x).alias(f"few_{x}") for x in names])
        return rows.join(F.broadcast(few), F.col(key) == F.col("few_"), "left").select(*rows.columns, *[F.col(f"few_{x}").alias(x) for x in names])
    heavy = values.where(F.col("n") * PARTS > total).select(F.col(key).alias("heavy_"), *[F.col(x).alias(f"heavy_{x}") for x in names])
    light = values.where(F.col("n") * PARTS <= total).select(F.col(key).alias("light_"), F.lit(-1).alias("unsalted_"), *[F.col(x).alias(f"light_{x}") for x in names])
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("heavy_"), "left")
    alone = F.col("heavy_").isNull() & F.col(key).isNotNull()
    salted = F.pmod(F.xxhash64(*(salt or rows.columns)), F.lit(PARTS)).cast("int")
    out = out.withColumns({"key_": F.when(alone, F.col(key)), "salt_": F.when(alone, -1).otherwise(salted)})
    out = out.join(light.hint("shuffle_hash"), (F.col("key_") == F.col("light_")) & (F.col("salt_") == F.col("unsalted_")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"heavy_{x}", f"light_{x}").alias(x) for x in names])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected edge list (a, b): root is the smallest node of its component.

    Each partition first shrinks its edges to a forest, and equal edges become one.  Then large-star and small-star steps
    alternate, each a grouped minimum and a join, until the edges no longer change; every state is a table in the shared
    folder.  A step makes no more rows than there are edges, and the edges of a node that has many, such as the centre of a
    star, are dealt to all tasks.  Links, nodes and labels stay on the executors; only a count
    and a checksum reach the driver.
    """
    prepare(edges.sparkSession)
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = stored(map_arrow(edges, _forests, "a long, b long").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def lowest(e: DataFrame, tasks: int) -> DataFrame:
        """Each node's lowest neighbour, and the number of its edges."""
        return stored(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(tasks), "lowest")

    before = state(edges)
    while before[0]:
        tasks = in_tasks(before[0])
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both, tasks)
        up = attach(both.where("b > a"), low.select("a", F.least("a", "m").alias("m"), "n"), "a")
        large = stored(up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks), "large")
        down = lowest(large, tasks)
        small = attach(large, down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").distinct().coalesce(tasks)
        new = stored(map_arrow(small, _forests, "a long, b long").distinct().coalesce(tasks), "edges")
        now = state(new)
        for x in (edges, low, large, down):
            dropped(x)
        edges = new
        if now == before:
            break
        before = now
    low = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return low.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: What modules keep between tasks in a worker: by module, how to let it go.
KEPT: dict[str, Callable[[], None]] = {}


def only(module: str) -> None:
    """Let go of what other modules than this one keep."""
    for name in [x for x in KEPT if x != module]:
        KEPT.pop(name)()


def release() -> None:
    """Give freed memory back to the machine: workers live on between stages, beside each other and a JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, kernel: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with freed memory given back at a task's end."""
    prepare(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(kernel.__module__)
        try:
            yield from kernel(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def by_group(kernel: Callable) -> Callable:
    """kernel of a table, with freed memory given back after large groups and from time to time."""
    done = [0]

    def run(t: pa.Table) -> pa.Table:
        only(kernel.__module__)
        out = kernel(t)
        done[0] += 1
        if t.nbytes > 1 << 18 or done[0] % 64 == 0:
            release()
        return out

    return run


def by_cogroup(kernel: Callable) -> Callable:
    """kernel of two tables, with freed memory given back after each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        only(kernel.__module__)
        out = kernel(left, right)
        release()
        return out

    return run
