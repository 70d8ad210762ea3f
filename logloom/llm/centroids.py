"""Centroid clustering over zone maps along a space-filling curve.

Vectors of integers are ordered along a Hilbert curve through their widest dimensions and cut into blocks, each
with its box (smallest and largest value of every dimension). For a block, the distances of its box from a
centroid bound those of its vectors; a centroid whose least distance is over another's greatest is nearest to
none of them. Only what is left is compared, exactly, with all vectors of the block at once.

Blocks are made once and kept; a round reads them, adds up each task's vectors by centroid, and moves those sums
alone. The driver holds k centroids of `size` components, and nothing that grows with the rows.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part;
a null id takes part like any other and comes last among the first centroids; of rows alike in id the smaller
vector is the earlier centroid; with fewer than k vectors each is a centroid; ties go to the smaller number;
sums over a long's range end at its limits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .meetings import scaled, sound

MOST = 2**63 - 1
BITS = 5
CURVE_DIMS = 12  # 60 bits of a long
BLOCK_ROWS = 256


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of each row of coordinates below 2**bits (Skilling's transposition, all rows at once)."""
    x = places.T.astype("i8").copy()
    n = len(x)
    for at in range(bits - 1, 0, -1):
        low = (1 << at) - 1
        for i in range(n):
            high = x[i] >> at & 1 == 1
            turned = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, turned)
            x[i] ^= turned
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros(x.shape[1], "i8")
    for at in range(bits - 1, 0, -1):
        gray ^= np.where(x[n - 1] >> at & 1 == 1, (1 << at) - 1, 0)
    x ^= gray
    key = np.zeros(x.shape[1], "i8")
    for at in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> at & 1
    return key


def along_curve(v: Column, dims: list[int], low: list[int], high: list[int]) -> Column:
    """The place of a vector, each of dims cut into 2**BITS steps between its limits."""
    at, lo = np.array(dims), np.array(low, "f8")
    step = (1 << BITS) / np.maximum(np.array(high, "f8") - lo + 1, 1)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            if not len(b):
                yield pa.array([], pa.int64())
                continue
            x = np.asarray(b.flatten()).reshape(len(b), -1)[:, at]
            yield pa.array(hilbert(np.clip((x - lo) * step, 0, (1 << BITS) - 1).astype("i8"), BITS))

    return F.arrow_udf(run, "long")(v)


def blocks(rows: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ids (array), v, lo, hi (binary, little-endian 64-bit integers) from rows of id and v."""
    spans = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop(F.col("x").cast("double")).alias("wide"))
    wide = sorted(spans.collect(), key=lambda r: (-r["wide"], r["k"]))[:CURVE_DIMS]  # a row for each of size dimensions
    place = along_curve(F.col("v"), [r["k"] for r in wide], [r["lo"] for r in wide], [r["hi"] for r in wide]) if wide else F.lit(0).cast("long")
    # equal vectors may lie in several partitions
    salted = rows.select("id", "v", place.alias("place"), F.xxhash64("id", F.monotonically_increasing_id()).alias("salt"))
    ordered = salted.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                some = b.slice(at, block_rows)
                x = np.asarray(some["v"].flatten()).reshape(-1, size).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some["id"].to_pylist()], pa.list_(pa.int64())), *(pa.array([y.tobytes()], pa.binary()) for y in (x, x.min(0), x.max(0)))],
                    ["ids", "v", "lo", "hi"],
                )

    return checkpointed(ordered.select("id", "v").mapInArrow(cut, "ids array<long>, v binary, lo binary, hi binary"))


def nearest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row of a block; how many centroids were compared."""
    most = max(abs(int(v)) for a in (lo, hi, c) for v in (a.min(), a.max()))
    kind = "f8" if 4 * most * most * x.shape[1] < 2**52 else object  # doubles hold such distances exactly
    x, lo, hi, c = (a.astype("i8").astype(kind) for a in (x, lo, hi, c))
    below, above = lo - c, c - hi
    gap = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(abs(below), abs(above))
    left = np.flatnonzero((gap * gap).sum(1) <= (far * far).sum(1).min())
    near = c[left]
    if kind == "f8":
        d = (x * x).sum(1)[:, None] - 2 * (x @ near.T) + (near * near).sum(1)
    else:
        d = np.stack([((x - y) ** 2).sum(1) for y in near], axis=1)
    best = d.argmin(1)
    return left[best], d[np.arange(len(x)), best], len(left)


def block_of(b: pa.RecordBatch, i: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, lo, hi = (np.frombuffer(b[c][i].as_py(), "<i8").reshape(-1, size) for c in ("v", "lo", "hi"))
    return x, lo[0], hi[0]


def moved(zones: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """Each centroid as the floored mean of the vectors it is nearest to; one that has none stays."""
    c = np.array(centroids, "i8")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * len(c), [[0] * size for _ in c]
        for b in batches:
            for i in range(b.num_rows):
                x, lo, hi = block_of(b, i, size)
                which, _, _ = nearest(x, lo, hi, c)
                small = max(-int(lo.min()), int(hi.max())) * len(x) < 2**62
                for k in np.unique(which):
                    own = x[which == k]
                    n[k] += len(own)
                    total[k] = [a + int(y) for a, y in zip(total[k], own.sum(0) if small else own.astype(object).sum(0), strict=True)]
        some = [k for k in range(len(c)) if n[k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([n[k] for k in some], pa.int64()), pa.array([[Decimal(v) for v in total[k]] for k in some], pa.list_(pa.decimal128(38, 0)))],
            ["cluster", "n", "sums"],
        )

    parts = zones.mapInArrow(sums, "cluster int, n long, sums array<decimal(38,0)>").select("cluster", "n", F.posexplode("sums").alias("k", "x"))
    for r in parts.groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k times size rows
        centroids[r["cluster"]][r["k"]] = int(r["x"]) // r["n"]
    return centroids


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1:") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector.

    k times size numbers are held by the driver and each task."""
    v = F.col(vector)
    rows = vectors.where(sound(v) & (F.size(v) == size)).select(F.col(key).cast("long").alias("id"), scaled(v, scale).alias("v"))
    first = rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    centroids = [list(r["v"]) for r in first.select("v").collect()]
    out = "id long, cluster int, distance long"
    if not centroids:
        return rows.select("id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    zones = blocks(rows, size)
    for _ in range(rounds):
        centroids = moved(zones, centroids, size)
    c = np.array(centroids, "i8")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                which, d, _ = nearest(*block_of(b, i, size), c)
                yield pa.RecordBatch.from_arrays([b["ids"][i].values, pa.array(which.astype("i4")), pa.array([min(int(y), MOST) for y in d], pa.int64())], ["id", "cluster", "distance"])

    found = checkpointed(zones.mapInArrow(assigned, out))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    names = [(j, min(sums.get(j, 0), MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(centroids)]
    named = vectors.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
