"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words, hashed pairs of neighbouring words and eight text shapes is shared by all
grades; ordered thresholds cut its score into grades: P(grade > j) = sigmoid(score - threshold j). A text
gets its expected grade and the probability of the upper grades, by which rows are selected.

The fit runs on a bounded sample of rated rows (``sample_rows``, dealt by a hash of the id). It is dealt into
lots of about ``lot_rows``; each round, every lot takes its own gradient steps over mini-batches from the
shared weights and thresholds, and the lots' results are averaged by their rows. What a task holds is bounded
by lot_rows times the hashed places, what the driver gets by the lots' weights. Thresholds stay in order as
they are a first one and positive steps.

Defined cases: a null or empty text has no features and its score is 0; rows without a rating or an id are
not learned from; with fewer than two grades every text gets the one grade (0 if none); repeated rows score
alike; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BITS, SHAPES = 17, 8
SIZE = (1 << BITS) + SHAPES
WORD = re.compile(r"\S+")
CACHE_ENTRIES = 300_000
_kept: dict[str, int] = {}


def places(words: list[str]) -> np.ndarray:
    """A 32-bit hash of each word."""
    try:
        return np.array([_kept[w] for w in words], "u4")
    except KeyError:
        if len(_kept) > CACHE_ENTRIES:
            _kept.clear()
        for w in words:
            if w not in _kept:
                _kept[w] = zlib.crc32(w.encode())
        return np.array([_kept[w] for w in words], "u4")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: words and pairs as log counts of one norm each, and a few shapes of the text behind them."""
    t = text or ""
    words = WORD.findall(t)
    if not words:
        return np.zeros(0, "i4"), np.zeros(0, "f4")
    one = places(words)
    two = (one[:-1] * np.uint32(0x9E3779B1) ^ one[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    at, value = [], []
    for some in (one & np.uint32((1 << BITS) - 1), two):
        place, n = np.unique(some, return_counts=True)
        v = np.log1p(n)
        at.append(place.astype("i4"))
        value.append(v / max(1e-9, np.linalg.norm(v)))
    b = np.bincount(np.frombuffer(t.encode(), "u1"), minlength=256)
    total, distinct = max(1, len(t)), len(set(words))
    punct = sum(int(b[i]) for i in range(33, 127) if not chr(i).isalnum())
    shapes = [distinct / len(words), int(b[65:91].sum()) / total, int(b[48:58].sum()) / total, punct / total, min(1.0, np.log1p(len(words)) / 10), min(1.0, total / len(words) / 20), len(set(t.split("\n"))) / (1 + t.count("\n")), int(b[128:].sum()) / total]
    return np.concatenate([*at, np.arange(SHAPES) + (1 << BITS)]).astype("i4"), np.concatenate([*value, np.array(shapes) * 3]).astype("f4")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cuts_of(first: float, steps: np.ndarray) -> np.ndarray:
    return first + np.r_[0, np.cumsum(np.exp(steps))]


def steps_of_lot(y: np.ndarray, at: list[np.ndarray], value: list[np.ndarray], state: dict[str, Any], rate: float, decay: float, batch: int, turn: int) -> dict[str, Any]:
    """The state after one pass over a lot's rows in mini-batches."""
    w, g2, c2, first, steps = (np.array(state[k], "f8") for k in ("w", "g2", "c2", "first", "steps"))
    order = np.random.default_rng(turn).permutation(len(y))
    for lo in range(0, len(order), batch):
        some = order[lo : lo + batch]
        n = np.array([len(at[i]) for i in some])
        cols, vals, row = np.concatenate([at[i] for i in some]), np.concatenate([value[i] for i in some]), np.repeat(np.arange(len(some)), n)
        score = np.bincount(row, w[cols] * vals, len(some))
        # likelihood of a grade: the difference of two neighbouring sigmoids
        above = sigmoid(score[:, None] - np.r_[-np.inf, cuts_of(first, steps), np.inf][None, :])
        i = np.arange(len(some))
        p = np.maximum(above[i, y[some]] - above[i, y[some] + 1], 1e-12)
        slope = above * (1 - above)
        upper, lower = slope[i, y[some]], slope[i, y[some] + 1]
        d = -(upper - lower) / p
        hit, back = np.unique(cols, return_inverse=True)
        grad = np.bincount(back, d[row] * vals, len(hit)) / len(some) + decay * w[hit]
        g2[hit] += grad**2
        w[hit] -= rate * grad / np.sqrt(g2[hit])
        by_cut = np.zeros(len(c2) + 2)
        np.add.at(by_cut, y[some], upper / p)
        np.add.at(by_cut, y[some] + 1, -lower / p)
        by_cut = by_cut[1:-1] / len(some)
        pull = np.r_[by_cut.sum(), np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(steps)]
        c2 += pull**2
        pull = rate * pull / np.sqrt(c2)
        first, steps = first - pull[0], np.clip(steps - pull[1:], -8, 8)
    return {"w": w, "g2": g2, "c2": c2, "first": first, "steps": steps}


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "quality", sample_rows: int = 20_000, lot_rows: int = 2_000, rounds: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-5) -> dict[str, Any]:
    spark = docs.sparkSession
    known = ratings.where(F.col(rating).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(rating).alias("__grade"))
    share = min(1.0, sample_rows / max(1, known.count()))
    lot = F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(1 << 20))
    drawn = lot < int(share * (1 << 20))

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = [features(t) for t in b.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([y.tobytes() for _, y in rows], pa.binary())], ["at", "value"])

    sample = docs.where(drawn).select(key, text).join(known.where(drawn), key)
    sample = sample.select(F.col("__grade").alias("grade"), F.xxhash64(F.lit("lot"), F.col(key)).alias("lot"), F.arrow_udf(hashed, "struct<at: binary, value: binary>")(F.col(text)).alias("f"))
    sample = checkpointed(sample.select("grade", "lot", "f.*"))
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    grades, total = sorted(sizes), sum(sizes.values())
    if len(grades) < 2:
        return {"grades": grades or [0], "weights": None, "cuts": None}
    lots = max(1, round(total / lot_rows))
    dealt = sample.select("grade", F.pmod("lot", F.lit(lots)).alias("lot"), "at", "value")
    above = np.array([sum(sizes[g] for g in grades[j + 1 :]) / total for j in range(len(grades) - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log((1 - above) / above)
    state: dict[str, Any] = {"w": np.zeros(SIZE, "f4"), "g2": np.full(SIZE, 1e-8, "f4"), "c2": np.full(len(cuts), 1e-8), "first": cuts[0], "steps": np.log(np.maximum(np.diff(cuts), 1e-2))}

    def pass_of(shared: Any, turn: int) -> Any:
        def taken(t: pa.Table) -> pa.Table:
            order = sorted(range(t.num_rows), key=list(zip(*(t[c].to_pylist() for c in ("at", "value", "grade")), strict=True)).__getitem__)  # whatever order the rows come in
            t = t.take(pa.array(order))
            at, value = ([np.frombuffer(x, kind) for x in t[c].to_pylist()] for c, kind in (("at", "i4"), ("value", "f4")))
            new = steps_of_lot(np.searchsorted(grades, t["grade"].to_numpy()), at, value, shared.value, rate, decay, batch, turn)
            thresholds = np.r_[new["c2"], new["first"], new["steps"]]
            return pa.table({"n": pa.array([len(at)], pa.int64()), "w": pa.array([new["w"].astype("f4").tobytes()]), "g2": pa.array([new["g2"].astype("f4").tobytes()]), "c": pa.array([thresholds.tobytes()])})

        return taken

    def mean(parts: list[Any], name: str, kind: str) -> np.ndarray:
        return np.average([np.frombuffer(r[name], kind) for r in parts], axis=0, weights=[r["n"] for r in parts])

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(state)
        parts = dealt.groupBy("lot").applyInArrow(pass_of(shared, turn), "n long, w binary, g2 binary, c binary").collect()  # a row per lot
        c, k = mean(parts, "c", "f8"), len(cuts)
        state = {"w": mean(parts, "w", "f4").astype("f4"), "g2": mean(parts, "g2", "f4").astype("f4"), "c2": c[:k], "first": c[k], "steps": c[k + 1 :]}
        shared.unpersist()
    return {"grades": grades, "weights": state["w"], "cuts": cuts_of(state["first"], state["steps"])}


def grade(texts: list[str | None], m: dict[str, Any]) -> list[np.ndarray]:
    """Expected grades, probabilities of the upper grades, likeliest grades."""
    values, w, cuts = np.array(m["grades"], "f8"), m["weights"], m["cuts"]
    if w is None:
        return [np.full(len(texts), values[0]), np.ones(len(texts)), np.full(len(texts), values[0])]
    score = np.array([float(w[at] @ value) if len(at) else 0.0 for at, value in map(features, texts)])
    above = np.hstack([np.ones((len(score), 1)), sigmoid(score[:, None] - cuts[None, :]), np.zeros((len(score), 1))])
    p = above[:, :-1] - above[:, 1:]
    return [p @ values, above[:, (len(cuts) + 1) // 2], values[p.argmax(1)] if len(p) else np.zeros(0)]


def graded(text: Column, model: dict[str, Any], spark: Any) -> Column:
    """struct<expected, tail, predicted>: expected grade, probability of more than the middle grade, likeliest grade."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.StructArray.from_arrays([pa.array(np.asarray(c, "f8")) for c in grade(b.to_pylist(), shared.value)], ["expected", "tail", "predicted"])

    return F.arrow_udf(run, "struct<expected: double, tail: double, predicted: double>")(text)
