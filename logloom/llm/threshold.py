"""Threshold joins of asked vectors with all rows, in the manner of L2AP.

Vectors hold integers. A meeting is a block of asked vectors with a lot of rows. Dimensions are ordered so that
the weak ones come first. For a threshold, a row's first dimensions are left out of the inverted index as far
as the norms of the two prefixes bound what they can add below the threshold (suffixes are indexed); a row all
of whose dimensions are left out is not indexed at all. Postings are read from the strongest dimension down,
partial scores are accumulated, and a pair goes as soon as its partial score and the norms of what remains
cannot reach the threshold. What is left is scored exactly.

A window asks for the k best scores between two limits. Its threshold begins high and is lowered until k rows
are found or the lower limit is reached; what is below the threshold of a full window cannot be among its k.

Rows go in two passes: the first takes a share of the rows and gives each window a lower limit (the k-th best
found there), the second takes the rest. A pass keeps the k best of a window in each task before they move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed
from .meetings import matrix, met

GROUP = 8  # dimensions read between two prunings
STEP = 64  # asked vectors at once
LEVELS = (0.25, 0.6, 1.0)  # of the way from the upper limit to the lower one
LEAST, MOST = -(2**63), 2**63 - 1


def prefix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, ... dimensions of each row."""
    out = np.zeros((len(x), x.shape[1] + 1))
    np.cumsum(x * x, axis=1, out=out[:, 1:])
    return np.sqrt(out, out=out)


def survivors(q: np.ndarray, t: np.ndarray, x: np.ndarray, qn: np.ndarray, xn: np.ndarray) -> list[np.ndarray]:
    """For each asked vector the rows whose inner product may reach its t; dimensions are in order."""
    d = x.shape[1]
    slack = 1e-9 * qn[:, d] * xn[:, d].max(initial=0) + 1e-6
    least = t - slack
    with np.errstate(divide="ignore", invalid="ignore"):
        # a prefix is left out if its norm stays below this for all asked vectors
        need = np.where(least[:, None] > 0, np.where(qn > 0, least[:, None] / qn, np.inf), -np.inf).min(0)
    left_out = (xn[:, 1:] < need[None, 1:]).cumprod(axis=1).sum(1)
    rows = np.flatnonzero(left_out < d)
    rows = rows[np.argsort(left_out[rows], kind="stable")]
    first = left_out[rows]  # rising: the postings of a dimension are the rows up to a place
    postings = np.where(np.arange(d)[None, :] >= first[:, None], x[rows], 0.0)
    partial = np.zeros((len(q), len(rows)))
    alive = np.ones((len(q), len(rows)), bool)
    for hi in range(d, 0, -GROUP):
        lo = max(0, hi - GROUP)
        n = int(np.searchsorted(first, hi - 1, side="right"))
        if n:
            partial[:, :n] += q[:, lo:hi] @ postings[:n, lo:hi].T
        rest = np.maximum(first, lo)
        alive &= partial + np.take(qn, rest, axis=1) * xn[rows, rest] >= least[:, None]
        some = alive.any(0)
        if some.sum() < 0.7 * len(some):
            rows, first, postings, partial, alive = rows[some], first[some], postings[some], partial[:, some], alive[:, some]
        if not len(rows):
            break
    return [rows[a] for a in alive]


def inner(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype("i8")
    return np.array([max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(row, q, strict=True)))) for row in x], "i8")


Asked = tuple[int, int, list[tuple[int, int, int]]]  # id, label, windows (number, lower and upper limit)


def filled(asked: list[Asked], q: np.ndarray, ids: np.ndarray, names: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int, same: bool) -> list[tuple[int, int, int, int]]:
    """(window, row, id, score): of each window the k best rows of the same (or of another) label, the asked id left out."""
    q0, x0 = q.astype("f8"), x.astype("f8")
    exact = np.abs(q0).max(initial=0) * np.abs(x0).max(initial=0) * x.shape[1] < 2**52
    order = np.argsort((x0 * x0).sum(0), kind="stable")
    q0, x0 = q0[:, order], x0[:, order]
    qn, xn = prefix_norms(q0), prefix_norms(x0)
    most = qn[:, -1] * xn[:, -1].max(initial=0)
    out: list[tuple[int, int, int, int]] = []
    for at in range(0, len(asked), STEP):
        open_ = {i: list(asked[i][2]) for i in range(at, min(at + STEP, len(asked)))}
        for level in LEVELS:
            now = np.array([i for i, w in open_.items() if w], int)
            if not len(now):
                break

            def threshold(i: int, lo: int, hi: int) -> float:
                lo_, hi_ = max(float(lo), -most[i] - 1), min(float(hi), most[i])
                return float(lo) if level == 1 else hi_ - level * (hi_ - lo_)  # noqa: B023

            t = np.array([min(threshold(i, lo, hi) for _, lo, hi in open_[i]) for i in now])
            for i, rows in zip(now, survivors(q0[now], t, x0, qn[now], xn), strict=True):
                own, label, _ = asked[i]
                rows = rows[(names[rows] != own) & ((labels[rows] == label) == same)]
                score = inner(x0[rows], q0[i], True) if exact else inner(x[rows], q[i], False)
                still = []
                for w, lo, hi in open_[i]:
                    least = lo if level == 1 else max(lo, int(np.ceil(max(threshold(i, lo, hi), -9e18))))
                    held = np.flatnonzero((score >= least) & (score <= hi))
                    if len(held) < k and level < 1:
                        still.append((w, lo, hi))
                        continue
                    best = held[np.lexsort((ids[rows[held]], names[rows[held]], -score[held]))[:k]] if exact else sorted(held, key=lambda j: (-int(score[j]), int(names[rows[j]]), int(ids[rows[j]])))[:k]  # noqa: B023
                    out += [(w, int(ids[rows[j]]), int(names[rows[j]]), int(score[j])) for j in best]
                open_[i] = still
    return out


OUT = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def once(asked: DataFrame, rows: DataFrame, k: int, same: bool, block: int, lot: int) -> DataFrame:
    """One pass: (window, row, id, score), k of each meeting at most."""

    def meeting(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return OUT.empty_table()
        size = key[0].as_py()
        asked_ = [(i, label, [(w["window"], w["lo"], w["hi"]) for w in ws]) for i, label, ws in zip(a["id"].to_pylist(), a["label"].to_pylist(), a["windows"].to_pylist(), strict=True)]
        found = filled(asked_, matrix(a, size), b["row"].to_numpy(), b["id"].to_numpy(), b["label"].to_numpy(), matrix(b, size), k, same)
        return pa.Table.from_arrays([pa.array(c) for c in np.array(found, "i8").reshape(-1, 4).T], schema=OUT)

    return met(asked, rows, ["d", "label"] if same else ["d"], meeting, "window long, row long, id long, score long", block, lot)


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows_filled(asked: DataFrame, rows: DataFrame, k: int, same: bool, block: int = 8192, lot: int = 16384, first: int = 16) -> DataFrame:
    """(window, rank, row, id, score): of each window the k best rows between its limits, fewer if there are no more.

    asked: row, id, label, d, v, windows (array<struct<window, lo, hi>>, numbers unlike any other); rows: row, id,
    label, d, v (row: a number of its own; d: the vector's length; only vectors of equal length meet).
    same: rows of the asked label, else of other labels. first: one row in so many goes into the first pass."""
    early = F.pmod(F.xxhash64(F.lit("early"), F.col("row")), F.lit(first)) == 0
    one = checkpointed(best(once(asked, rows.where(early), k, same, block, lot), k))
    limits = one.where(F.col("rank") == k).select("window", F.col("score").alias("limit"))
    flat = asked.select("row", F.explode("windows").alias("w")).select("row", "w.*").join(limits, "window", "left")
    again = flat.groupBy("row").agg(F.collect_list(F.struct("window", F.greatest("lo", F.coalesce("limit", "lo")).alias("lo"), "hi")).alias("windows"))
    two = once(asked.drop("windows").join(again, "row"), rows.where(~early), k, same, block, lot)
    return best(one.drop("rank").unionByName(two), k)
