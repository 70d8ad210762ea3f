"""Vector operators against brute force: repeated ids, ties, unequal lengths, nulls, hot labels, copies and very large components."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import centroids, negatives, queries, threshold, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row string, d int, v int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, label, "x", 1, 2) for k, v, label in rows], SCHEMA)


def some(n, size, seed, hot=0.5):
    r = np.random.default_rng(seed)
    mids = r.normal(size=(3, size)) * 0.2
    return [(int(k), [float(np.float32(x)) for x in mids[k % 3] + r.normal(size=size) * 0.1], 1 if r.random() < hot else int(r.integers(0, 5))) for k in range(n)]


BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None] * 12, 1), (903, [float("nan")] * 24, 2), (904, [float("inf")] * 24, 2), (None, [0.5] * 24, 1), (905, [0.5] * 24, None), (950, [0.25] * 3, 1), (951, [0.5] * 3, 1), (953, [0.125] * 3, 2)]


def whole(rows, scale):
    for k, v, label in rows:
        if k is not None and v and None not in v and np.isfinite(v).all():
            yield k, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], label


def test_search_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [3.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    found = [(r["rank"], r["vec_id"], r["score"]) for r in vectors.top_k(table(spark, rows), scale=1).orderBy("rank").collect()]
    assert found == [(1, 1, 3), (2, 2, 2), (3, 1, 1)]


@pytest.mark.parametrize("first", [1, 2, 1000])
def test_search(spark, first):
    rows = [*some(300, 24, 0), *BAD, (17, [0.3] * 24, 1), (50, [0.1] * 24, 1), (40, some(41, 24, 0)[40][1], 1)]
    found = defaultdict(list)
    for r in sorted(vectors.top_k(table(spark, rows), every=50, split=64, block=4, first=first).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = list(whole(rows, 1024))
    want = defaultdict(list)
    for q, qv, _ in ints:
        if q % 50 == 0:
            want[q] += [(x, sum(a * b for a, b in zip(qv, xv, strict=True))) for x, xv, _ in ints if x != q and len(xv) == len(qv)]
    assert found == {q: sorted(s, key=lambda p: (-p[1], p[0]))[:10] for q, s in want.items() if s}
    assert vectors.top_k(table(spark, rows).limit(0)).count() == 0


def mined(rows, every, positives, k):
    ints = [(i, *r) for i, r in enumerate(whole(rows, 256)) if r[2] is not None]
    out = Counter()
    for i, a, av, la in ints:
        if a % every:
            continue
        scores = [(sum(x * y for x, y in zip(av, bv, strict=True)), b, j, lb) for j, b, bv, lb in ints if b != a and len(bv) == len(av)]
        for p, b, _, _ in sorted((s for s in scores if s[3] == la), key=lambda s: (-s[0], s[1]))[:positives]:
            near = sorted(((n, c) for n, c, _, lc in scores if lc != la and 30 * p <= 100 * n <= 90 * p), key=lambda s: (-s[0], s[1]))[:k]
            for rank, (n, c) in enumerate(near, 1):
                out[a, b, rank, c, p, n] += 1
    return out


@pytest.mark.parametrize("first", [1, 3, 10_000])
def test_hard_negatives(spark, first, monkeypatch):
    """A label that half the rows have, ties, copies, an id that repeats (also an anchor's), in small blocks and lots."""
    base = some(260, 24, 1)
    rows = [*base, *BAD, *[(k, base[3][1], 4) for k in range(300, 330)], (60, base[7][1], 1), (17, base[17][1], base[17][2]), (500, [0.0] * 24, 1), (340, [-x for x in base[20][1]], 1)]
    real = threshold.windows_filled
    monkeypatch.setattr(negatives, "windows_filled", lambda *a, **b: real(*a, **(b | {"block": 3, "lot": 50, "first": first})))
    found = negatives.hard_negatives(table(spark, rows), every=20)
    got = Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())
    assert got == mined(rows, 20, 5, 10) and len(got) > 100


def test_hard_negatives_without_rows(spark):
    none = table(spark, BAD[:5])
    assert negatives.hard_negatives(none).count() == 0 == negatives.hard_negatives(table(spark, [(0, [1.0], 1)])).count()


def test_huge_components(spark):
    """Scores that doubles can't hold are exact; what a long can't hold ends at its limits."""
    big = 3.0e9
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big / 2, 5.0], 2), (3, [3e38, 1.0], 1)]
    found = {(r["positive_id"], r["negative_id"]): (r["positive_score"], r["negative_score"]) for r in negatives.hard_negatives(table(spark, rows), scale=1).collect()}
    a, b, c = (int(np.float32(x)) for x in (big, big, big / 2))
    assert found[1, 2] == (a * b + 3, a * c + 5)
    assert (3, 2) in found or 100 * (a * c + 5) < 30 * (2**63 - 1)


def test_threshold_join_leaves_out_what_cannot_reach():
    r = np.random.default_rng(2)
    x = np.floor(r.normal(size=(400, 16)) * np.linspace(1, 40, 16))
    q = x[:5]
    t = 0.8 * (q * q).sum(1)
    rows = threshold.survivors(q, t, x, threshold.prefix_norms(q), threshold.prefix_norms(x))
    for i, found in enumerate(rows):
        assert set(np.flatnonzero(x @ q[i] >= t[i])) <= set(found) and len(found) < 200


def clusters(rows, size, k, rounds):
    kept = [(i, v) for i, v in ((i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v, _ in rows if v and len(v) == size and None not in v and np.isfinite(v).all())]
    c = [v for _, _, v in sorted(((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest()), v, v) for i, v in kept)][:k]
    for step in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, y, strict=True)) for y in c] for _, v in kept]
        which = [x.index(min(x)) for x in d]
        if step < rounds:
            for j in range(len(c)):
                own = [v for (_, v), w in zip(kept, which, strict=True) if w == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    inertia = Counter()
    for w, x in zip(which, d, strict=True):
        inertia[w] += x[w]
    return Counter((i, w, x[w], inertia[w], inertia.total(), hashlib.sha256(",".join(map(str, c[w])).encode()).hexdigest()) for (i, _), w, x in zip(kept, which, d, strict=True))


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_clusters(spark, k):
    base = some(150, 24, 3)
    rows = [*base, *BAD, *[(k, base[3][1], 4) for k in range(300, 420)], (17, base[3][1], 1), (17, base[4][1], 1)]
    found = centroids.clustered(table(spark, rows), size=24, k=k, rounds=2)
    assert found.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == clusters(rows, 24, k, 2)


def test_clusters_without_rows(spark):
    assert centroids.clustered(table(spark, BAD)).count() == 0
    assert centroids.clustered(table(spark, BAD).limit(0), size=3).count() == 0
    far = centroids.clustered(table(spark, [(1, [3e38, -3e38], 1), (2, [3e38, -3e38], 1), (3, [0.0, 0.0], 1)]), size=2, k=1, rounds=0)
    assert max(r["distance"] for r in far.collect()) == 2**63 - 1


def test_curve():
    """Neighbours on the curve are neighbours in space, and every place comes once."""
    bits, n = 3, 3
    grid = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
    key = centroids.hilbert(grid, bits)
    assert sorted(key) == list(range(1 << bits * n))
    assert set(abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)) == {1}


def test_boxes_rule_centroids_out():
    x = np.arange(20).reshape(10, 2)
    c = np.array([[0, 0], [10, 10], [1000, 1000]])
    which, d, compared = centroids.nearest(x, x.min(0), x.max(0), c)
    want = ((x[:, None, :] - c) ** 2).sum(2)
    assert compared == 2 and (which == want.argmin(1)).all() and (d == want.min(1)).all()


def test_registered(spark, tmp_path):
    """The registered queries on a table with every kind of row."""
    rows = [*[(k, v, label) for k, v, label in some(300, 64, 5)], *BAD, (7, [0.25] * 64, 9), (14, [0.25] * 64, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    shifted = [(k, v, label if k is None or k % 7 or label is None else (label + 1) % 10) for k, v, label in rows]
    got = Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in queries.op11_negatives(spark, str(tmp_path)).collect())
    assert got == mined([(k, [np.float32(x) if x is not None else None for x in v] if v else v, label) for k, v, label in shifted], 100, 5, 10) and got
    found = queries.op13_centroids(spark, str(tmp_path))
    assert "vec_id" in found.columns and Counter(tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == clusters(rows, 64, 16, 3)
    assert found.where(F.col("distance") < 0).count() == 0
