"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative per group.

1. Equal vectors become one, with their count.
2. Centroids are fitted to at most SAMPLE vectors, a documented bound that changes speed only.  Every vector has the cell
   of its nearest centroid as home and is a guest of each cell in which a partner could be at home: for a partner y of x
   at home in d, y.d >= y.c for x's home c, and |x - y| <= sqrt(2 - 2 cosine), so x.(c - d) <= |x - y| |c - d|; nor can x
   be farther from d than the cell's radius and the partner's angle.  So no link is lost, wherever cells are cut.
3. Homes and guests of a cell are cut into blocks of a number of components, and each pair of blocks is one product: in single precision, and again
   in double precision for whatever comes near the threshold.  A vector meets all its partners in its home cell, so links
   are counted there; they leave as a forest.
4. Components of the links, joined back to all copies.

Memory: a task holds one pair of blocks.  A cell of any size is cut, and copies are counted before they are shuffled.
The cost: vectors without structure are guests of nearly every cell, and all pairs are then compared.
Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of different
lengths do not link; rows that share a vec_id are one node of the links but count as partners; rows of null vec_id count
as partners and get a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common as c

#: Vectors that centroids are fitted to, vectors to a cell, most cells, k-means steps; components in a block of homes and of all.
SAMPLE, CELL, CELLS, STEPS = 16_384, 4096, 2048, 8
HOMES, OTHERS = 1 << 19, 1 << 21
#: Single precision may err by so much.
SLACK = 1e-4


def _pack(kind: str):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as the bytes of their floats; null for what links with nothing."""
        for b in batches:
            out: list[bytes | None] = []
            for v in b.column(1):
                if not v.is_valid or v.values.null_count or not len(v.values):
                    out.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return kernel


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(data: Iterable[bytes], dim: int, kind: str) -> np.ndarray:
    """Unit vectors, in double precision."""
    x = np.frombuffer(b"".join(data), kind).reshape(-1, dim).astype(np.float64)
    return unit(x) if len(x) else x


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids of unit vectors x."""
    rng = np.random.default_rng(0)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(STEPS):
        home = (x.astype(np.float32) @ centers.T.astype(np.float32)).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(1))
        centers[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return centers


def _assign(x: np.ndarray, centers: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, cosine to home, mask of the cells that x may be a guest of, the radius left aside)"""
    near = x @ centers.T
    home = near.argmax(1)
    best = near[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centers @ centers.T)))
    guest = (best[:, None] - near) <= np.sqrt(2 - 2 * cosine) * apart[home] + 1e-9
    guest[np.arange(len(x)), home] = False
    return home, near, guest


def _cells(dim: int, kind: str, centers: np.ndarray, cosine: float, radius: np.ndarray | None, plan: dict | None):
    """Without a plan: (cell, homes, guests, least cosine of a home) of a task.  With one: packed vectors dealt to pairs of blocks."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centers)
        homes, guests, least = np.zeros(k, np.int64), np.zeros(k, np.int64), np.ones(k)
        for b in batches:
            raw = b.column("v").to_pylist()
            x = vectors(raw, dim, kind)
            if not len(x):
                continue
            home, near, guest = _assign(x, centers, cosine)
            if radius is not None:
                guest &= np.arccos(np.clip(near, -1, 1)) <= radius + np.arccos(cosine) + 1e-9
            if plan is None:
                homes += np.bincount(home, minlength=k)
                guests += guest.sum(0)
                np.minimum.at(least, home, near[np.arange(len(x)), home])
                continue
            id_, times = b.column("rep").to_numpy(), b.column("times").to_numpy()
            slot = (c.mix(id_.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
            table = np.frombuffer(b"".join(raw), np.uint8).reshape(len(x), -1)
            at: list[tuple] = []

            def deal(rows: np.ndarray, role: int, places: list[tuple[int, int, int]]) -> None:
                if len(rows):
                    data = len(rows).to_bytes(8, "little") + id_[rows].tobytes() + times[rows].tobytes() + table[rows].tobytes()
                    at.extend((*place, role, data) for place in places)

            for cell in range(k):
                rows = np.flatnonzero((home == cell) | guest[:, cell])
                nq, nc = plan["homes"][cell], plan["others"][cell]
                mine = rows[home[rows] == cell]
                for q in range(nq):
                    deal(mine[slot[mine] % nq == q], 0, [(cell, q, j) for j in range(nc)])
                for j in range(nc):
                    deal(rows[slot[rows] // 64 % nc == j], 1, [(cell, q, j) for q in range(nq)])
            columns = list(zip(*at, strict=True)) or [()] * 5
            types = [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["cell", "i", "j", "role", "data"])
        if plan is None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(homes), pa.array(guests), pa.array(least)], names=["cell", "homes", "guests", "least"])

    return kernel


def _products(dim: int, kind: str, cosine: float):
    def kernel(t: pa.Table) -> pa.Table:
        role, id_, times, v = [], [], [], []
        for r, data in zip(t.column("role").to_pylist(), t.column("data").to_pylist(), strict=True):
            n = int.from_bytes(data[:8], "little")
            role.append(np.full(n, r))
            id_.append(np.frombuffer(data, np.int64, n, 8))
            times.append(np.frombuffer(data, np.int64, n, 8 + 8 * n))
            v.append(data[8 + 16 * n :])
        role, id_, times = (np.concatenate(y) for y in (role, id_, times))
        x = vectors(v, dim, kind)
        q, o = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        xq, xo = x[q], x[o]
        low = xo.astype(np.float32).T.copy()
        links, a, b = np.zeros(len(q), np.int64), [], []
        for i in range(0, len(q), 512):
            r, s = np.nonzero(xq[i : i + 512].astype(np.float32) @ low >= cosine - SLACK)
            r += i
            for n in range(0, len(r), 1 << 18):
                rn, sn = r[n : n + (1 << 18)], s[n : n + (1 << 18)]
                ok = (np.einsum("ij,ij->i", xq[rn], xo[sn]) >= cosine) & (id_[q[rn]] != id_[o[sn]])
                rn, sn = rn[ok], sn[ok]
                np.add.at(links, rn, times[o[sn]])
                a.append(id_[q[rn]])
                b.append(id_[o[sn]])
            if sum(map(len, a)) > 1_000_000:
                n_, r_ = c.roots(np.concatenate(a), np.concatenate(b))
                a, b = [n_], [r_]
        none = np.empty(0, np.int64)
        node, root = c.roots(np.concatenate([none, *a]), np.concatenate([none, *b]))
        mine = links > 0
        return pa.table({"rep": np.concatenate([id_[q[mine]], node]), "root": np.concatenate([id_[q[mine]], root]), "links": np.concatenate([links[mine], np.zeros(len(node), np.int64)])})

    return kernel


def near_duplicates(embeddings: DataFrame, *, cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings(vec_id, embedding)."""
    spark = c.prepare(embeddings.sparkSession)
    # Values that fit into 32 bits are kept so.
    small = embeddings.schema["embedding"].dataType.elementType.simpleString() in ("float", "tinyint", "smallint")
    kind, width = ("float32", 4) if small else ("float64", 8)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if small else "array<double>"))
    rows = c.stored(c.map_arrow(rows, _pack(kind), "vec_id long, v binary"), "vectors").withColumn("key", F.xxhash64("v"))
    # A vector's representative is named by its smallest vec_id; copies are those of equal bytes.
    reps = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("key").alias("key"))
    # Vectors of null ids alone get ids above all others, so that none of these names a component that has a vec_id.
    top = rows.agg(F.max("vec_id")).first()[0]
    spare = F.monotonically_increasing_id() + F.lit(0 if top is None else max(top, -1) + 1).cast("long")
    reps = c.stored(reps.where("rep is not null").union(reps.where("rep is null").withColumn("rep", spare)), "distinct")
    dims = {r[0] // width: r[1] for r in reps.groupBy(F.octet_length("v")).agg(F.count("*")).collect()}
    found = spark.createDataFrame([], "rep long, root long, links long")
    for dim, n in dims.items():
        mine = reps.where(F.octet_length("v") == width * dim)
        taken = [bytes(r[0]) for r in mine.orderBy("key").limit(sample).select("v").collect()]
        centers = spherical_kmeans(vectors(taken, dim, kind), max(1, min(CELLS, n // CELL)))
        told = c.map_arrow(mine, _cells(dim, kind, centers, cosine, None, None), "cell long, homes long, guests long, least double")
        told = {r[0]: r for r in told.groupBy("cell").agg(F.sum("homes"), F.sum("guests"), F.min("least")).collect()}
        k = range(len(centers))
        radius = np.array([np.arccos(np.clip(told[i][3], -1, 1)) if told[i][1] else -np.pi for i in k])
        # A vector is sent once for each block of homes of its cells: large blocks, of so many components, keep that low.
        rows_of = lambda n, most: max(1, -(-n * dim // most)) if n else 0
        plan = {"homes": [rows_of(told[i][1], HOMES) for i in k], "others": [rows_of(told[i][1] + told[i][2], OTHERS) if told[i][1] else 0 for i in k]}
        dealt = c.map_arrow(mine, _cells(dim, kind, centers, cosine, radius, plan), "cell int, i int, j int, role int, data binary")
        found = found.union(dealt.groupBy("cell", "i", "j").applyInArrow(c.by_group(_products(dim, kind, cosine)), "rep long, root long, links long"))
    found = c.stored(found, "links")
    reached = c.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("v").alias("w"), F.col("key").alias("k"), F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"))
    out = rows.join(named, (F.col("key") == F.col("k")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
