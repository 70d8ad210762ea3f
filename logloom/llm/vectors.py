"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are turned into integers. For a cut into segments, the means and deviations of each segment bound
the distance of two vectors from below, and so, their norms known, the inner product from above. Bounds
over few segments are tried first, finer ones for what is left, and the inner product only for the
survivors that can still enter the k best.

Queries are laid out in blocks and rows in lots, both of bounded size, that meet pairwise; a meeting bounds its
queries a few at a time and returns k rows a query at most. Rows go in two passes: a share of them first, whose
k-th best score of each query is the least that the second pass looks for and returns.

Defined cases: vectors that are null or empty or hold null or non-finite components, and rows without an id,
take no part; vectors of unequal length never meet; rows that repeat an id are rows of their own, none of them
a candidate of a query of that id, and queries that repeat an id share one ranking; ties go to the smaller id;
with fewer than k other rows all are returned; scores beyond a long end at its limits; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed
from .meetings import matrix, met, scaled, sound

LEVELS = (4, 16)
STEP = 128  # queries bounded at once


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose products of two rows sum to an upper bound of the rows' inner product."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    cols = [f(p) * np.sqrt(p.shape[1]) for p in parts for f in (lambda p: p.mean(1), lambda p: p.std(1))]
    return np.stack(cols, axis=1)


def best(queries: np.ndarray, ids: np.ndarray, least: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best of each query among rows of other ids, none below the query's least."""
    out: list[tuple[int, int, int]] = []
    q, x = queries.astype("f8"), rows.astype("f8")
    exact = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]) < 2**52
    coarse_q, coarse_x = statistics(q, LEVELS[0]), statistics(x, LEVELS[0])
    fine_q, fine_x = statistics(q, LEVELS[1]), statistics(x, LEVELS[1])
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0) + 1e-6
    for i in range(len(q)):
        if i % STEP == 0:
            coarse = coarse_q[i : i + STEP] @ coarse_x.T
        bound = np.where(row_ids == ids[i], -np.inf, coarse[i % STEP])
        floor = float(least[i])
        if np.count_nonzero(bound > -np.inf) > k:
            first = np.argpartition(-bound, k - 1)[:k]
            floor = max(floor, np.min(x[first] @ q[i]))
        left = np.flatnonzero((bound > -np.inf) & (bound >= floor - slack[i]))
        left = left[fine_x[left] @ fine_q[i] >= floor - slack[i]]
        if exact:
            score = (x[left] @ q[i]).astype("i8")
        else:
            wide = [sum(int(a) * int(b) for a, b in zip(rows[j], queries[i], strict=True)) for j in left]
            score = np.array([max(-(2**63), min(2**63 - 1, s)) for s in wide], "i8")
        left, score = left[score >= least[i]], score[score >= least[i]]
        order = np.lexsort((row_ids[left], -score))[:k] if exact else sorted(range(len(left)), key=lambda j: (-int(score[j]), int(row_ids[left[j]])))[:k]
        out += [(int(ids[i]), int(row_ids[left[j]]), int(score[j])) for j in order]
    return out


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", block: int = 32768, split: int = 16384, first: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose key is divisible by every.

    first: one row in so many goes into the first pass."""
    v = F.col(vector)
    whole = vectors.where(sound(v) & F.col(key).isNotNull())
    whole = checkpointed(whole.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.size(v).alias("d"), scaled(v, scale).alias("v")))
    asked = whole.where(F.col("id") % every == 0)
    early = F.pmod(F.xxhash64(F.lit("early"), F.col("row")), F.lit(first)) == 0

    def meeting(of: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return OUT.empty_table()
        size = of[0].as_py()
        found = best(matrix(a, size), a["id"].to_numpy(), a["least"].to_numpy(), matrix(b, size), b["id"].to_numpy(), k)
        return pa.Table.from_arrays([pa.array(c) for c in np.array(found, "i8").reshape(-1, 3).T], schema=OUT)

    def once(asked: DataFrame, rows: DataFrame) -> DataFrame:
        return met(asked, rows, ["d"], meeting, "query_id long, vec_id long, score long", block, split)

    none = F.lit(-(2**63)).alias("least")
    one = checkpointed(ranked(once(asked.select("*", none), whole.where(early)), k))
    limits = one.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    again = asked.join(limits, "id", "left").select(*asked.columns, F.coalesce("limit", none).alias("least"))
    return ranked(one.drop("rank").unionByName(once(again, whole.where(~early))), k)
