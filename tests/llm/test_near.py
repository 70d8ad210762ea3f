"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline as pipeline
from logloom.llm import minhash


def sets(docs, words=5):
    out = {}
    for k, t in docs:
        w = (t or "").lower().split()
        size = min(words, len(w))
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    return out


def smallest(s, threshold=0.8):
    """The smallest id reachable over pairs of a similarity of at least threshold."""
    ids, label = sorted(s), {k: k for k in s}
    links = [(a, b) for a in ids for b in ids if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])]
    for _ in ids:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label
    return label


def edited(r, w, n):
    w = list(w)
    for i in r.sample(range(len(w)), n):
        w[i] = f"other{r.randrange(10**6)}"
    return w


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_go(spark):
    r = random.Random(3)
    docs = []
    for _ in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(150, 400))]
        docs += [" ".join(x) for x in (w, edited(r, w, 1), edited(r, w, len(w) // 60), edited(r, w, len(w) // 25))]
    docs += ["two words", "two words", "Two  words", "two other", ""]
    docs = list(enumerate(docs))
    want = {k for k, c in smallest(sets(docs)).items() if k == c}
    left = pipeline.one_of_each(spark, frame(spark, docs), "")
    assert len(want) < 150 and {x["doc_id"] for x in left.collect()} == want


def test_crowded_bands(spark):
    """Many near copies of one text, and pairs behind one long passage."""
    r = random.Random(4)
    w = [f"w{k}" for k in range(200)]
    docs = [" ".join(edited(r, w, 1)) for _ in range(150)]
    for _ in range(50):
        own = [f"v{r.randrange(10**6)}" for _ in range(100)]
        docs += [" ".join(w + own), " ".join(w + edited(r, own, 1))]
    docs = list(enumerate(docs))
    got = {x["doc_id"]: x["component"] for x in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == smallest(sets(docs))


def test_crowds_are_exact(spark):
    """One band for all: rings of texts about several middles, so that hubs settle some and leave others; against all pairs."""
    r = random.Random(6)
    docs = []
    for _ in range(2):
        w = [f"w{r.randrange(300)}" for _ in range(160)]
        for n in (1, 2, 3, 4, 6, 9):
            docs += [" ".join(edited(r, w, n)) for _ in range(4)]
        chain = w
        for _ in range(12):  # each like the one before, the last unlike the first
            chain = edited(r, chain, 2)
            docs.append(" ".join(chain))
    docs = [*enumerate(docs), (1000, ""), (1001, None), (1002, "two words")]
    nodes = {}
    for k, t in docs:
        nodes.setdefault(frozenset(sets([(k, t)])[k]), k)
    s = {k: set(x) for x, k in nodes.items()}
    want = smallest(s)
    texts = spark.createDataFrame([(k, t) for k, t in docs if k in s], "k long, t string")
    used = texts.select("k", minhash.sets(texts["t"], 5).alias("x")).selectExpr("k AS node", "x.s", "x.map", "octet_length(x.s) / 8 AS n")
    from logloom.llm import components
    from pyspark.sql import functions as F

    crowd = used.select(F.lit(1).alias("key"), "node")
    none = used.selectExpr("node AS a", "node AS b").limit(0)
    for hubs in (12, 64):
        found = {x["node"]: x["component"] for x in components.components(minhash.crowd_links(crowd, used, used, none, 0.8, hubs)).collect()}
        assert {k: found.get(k, k) for k in s} == want
    assert 4 < len(set(want.values())) < len(s)
    got = {x["doc_id"]: x["component"] for x in minhash.near_duplicates(frame(spark, docs), full=3).collect()}
    label = {k: want[nodes[frozenset(sets([(k, t)])[k])]] for k, t in docs}
    assert got == label


def test_parity_maps_bound_the_similarity():
    """Maps never differ in more bits than their sets in shingles, whatever their sizes; and tell most unlike pairs."""
    import numpy as np

    r, told = np.random.default_rng(7), 0
    for n in (0, 1, 5, 255, 256, 257, 600, 5000):
        for share in (0.0, 0.5, 0.75, 0.9, 1.0):
            both = r.integers(0, 2**63, int(n * share), "u8")
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, k, "u8")])) for k in (n - len(both), (n - len(both)) * 3 // 2))
            x, y = (np.frombuffer(minhash.parity(s), "u1") for s in (a, b))
            d = minhash.differing(x, y)
            assert d == minhash.differing(y, x) <= len(np.setxor1d(a, b))
            told += share < 0.8 and n > 200 and len(a) + len(b) - d < 0.8 * (len(a) + len(b) + d)
    assert told == 15


def test_simhash_brings_together_what_bands_miss(spark):
    """One band of 400 values, which unlike sets hardly ever share: pairs of two bits are linked all the same, if the exact check holds."""
    from logloom.llm.simhash import fingerprint

    r, docs = random.Random(9), []
    for _ in range(20):
        w = [f"w{r.randrange(10**6)}" for _ in range(1200)]
        docs += [" ".join(w), " ".join(edited(r, w, 2))]
    docs += ["a b c", "a  b c", "", "   "]
    docs = list(enumerate(docs))
    near = [k for k in range(0, 40, 2) if (fingerprint(docs[k][1]) ^ fingerprint(docs[k + 1][1])).bit_count() <= 2]
    assert len(near) > 5
    got = {x["doc_id"]: x["component"] for x in minhash.near_duplicates(frame(spark, docs), n=1, rows=400).collect()}
    assert all(got[k + 1] == k for k in near) and got[41] == 40 and got[43] == 42


def test_workers_keep_one_model():
    """A step's model gives way to the next one's."""
    from logloom.llm import common

    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [common.model(k, make(k)) for k in ("a", "a", "b", "b", "a")] == ["a", "a", "b", "b", "a"]
    assert made == ["a", "b", "a"] and list(common._models) == ["a"]
    common.released()
    assert not common._models


def test_a_long_passage_is_no_crowd(spark):
    """Unlike texts behind one passage share bands but none of their rarest shingles; near copies of one text share some."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    w = [f"w{k}" for k in range(150)]
    unlike = [" ".join(w + [f"v{r.randrange(10**6)}" for _ in range(80)]) for _ in range(120)]
    docs = list(enumerate(unlike + [" ".join(edited(r, w, k % 3)) for k in range(60)]))
    s = sets(docs)
    used = frame(spark, docs).select(F.col("doc_id").alias("node"), minhash.sets(F.col("text"), 5).alias("x")).select("node", "x.s").dropDuplicates(["s"])
    rows = minhash.prefixes(used, 0.8).collect()
    assert {x["node"] for x in rows} and all(x["node"] >= len(unlike) for x in rows)
    keys = {}
    for x in rows:
        keys.setdefault(x["node"], set()).add(x["key"])
    for a in keys:
        assert all(keys[a] & keys[b] for b in keys if s[a] != s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))
    got = {x["doc_id"]: x["component"] for x in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == smallest(s)


def test_maps_meet_as_matrices():
    """The pairs of other components that the bound leaves, as for single pairs; maps of several sizes in one crowd."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 280, "u8")
    found = [np.unique(np.concatenate([base[: 280 - k], r.integers(0, 2**63, j, "u8")])) for k in range(0, 60, 6) for j in (0, 3, 12)]
    maps, n, label = [minhash.parity(x) for x in found], [len(x) for x in found], [k % 4 for k in range(len(found))]
    assert len({len(m) for m in maps}) > 1
    hubs = pa.table({"hub": [0, 7, 20], "own": [label[k] for k in (0, 7, 20)], "n": [n[k] for k in (0, 7, 20)], "map": pa.array([maps[k] for k in (0, 7, 20)], pa.binary())})
    rows = pa.table({"node": list(range(len(found))), "label": label, "n": n, "map": pa.array(maps, pa.binary())})
    got = {tuple(x.values()) for x in minhash.met_maps(0.8)((), hubs, rows).to_pylist()}
    want = set()
    for a in (0, 7, 20):
        for b in range(len(found)):
            d = minhash.differing(*(np.frombuffer(maps[k], "u1") for k in (a, b)))
            if label[a] != label[b] and n[a] + n[b] - d >= 0.8 * (n[a] + n[b] + d) - 1e-9 and min(n[a], n[b]) >= 0.8 * max(n[a], n[b]):
                want.add((a, b))
    assert got == want and len(want) > 10
    assert minhash.met_maps(0.8)((), hubs.slice(0, 0), rows).num_rows == 0
