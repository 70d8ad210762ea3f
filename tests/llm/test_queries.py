"""The registered queries on a small table with rows without an id, repeated rows, empty and long texts, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logloom.llm import language, quality, queries, toxicity

EN, DE = "river stone walk calm tree house garden window".split(), "der hund und die katze mit dem haus größe".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(5)
    docs, labels = [], []
    for k in range(300):
        de = k % 3 == 0
        words = [r.choice(DE if de else EN) + r.choice(["", "", "s", "en"]) for _ in range(30)]
        bad, good = k % 5 == 1, k % 2 == 0
        if bad:
            words[r.randrange(30)] = r.choice(["idiot", "moron"])
        if good:
            words[3:6] = ["well", "made", "text"]
        docs.append((k, " ".join(words), "de" if de else "en", "s", 1))
        labels.append((k, int(good), int(bad)))
    docs += [(1000, None, "en", "s", None), (1001, "", "en", "s", 0), (1002, "12 !! 7", "de", "s", 1), (None, docs[3][1], "de", "s", 1), docs[4], (1003, "tree " * 60_000, None, "s", 1), (1004, "x" * 300_000, None, "s", 1)]
    path = str(tmp_path_factory.mktemp("q"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, labels


def held(k):
    return k is None or zlib.crc32(str(k).encode()) % 5 == 0


def test_language(spark, sf):
    """Counts, entries and scores worked out anew."""
    path, docs, _ = sf
    rows = queries.op2_language(spark, path).collect()
    words, texts = defaultdict(Counter), Counter()
    for k, t, lang, *_ in docs:
        if k is not None and not held(k) and lang and t is not None:
            words[lang].update(re.findall(r"[^\W\d_]+", t.lower()))
            texts[lang] += 1
    langs = sorted(words)
    table = {0: words}
    for n in language.ORDERS:
        table[n] = {}
        for lang in langs:
            c = Counter()
            for w, m in words[lang].items():
                for i in range(len(w) + 3 - n):
                    c[f"<{w}>"[i : i + n]] += m
            table[n][lang] = c
    total = {(lang, n): sum(table[n][lang].values()) for n in table for lang in langs}
    known = {n: {g for lang in langs for g in table[n][lang] if n or sum(table[0][x][g] for x in langs) > 1} for n in table}
    log = lambda n, g: np.array([math.log((table[n][lang][g] + 0.1) / (total[lang, n] + 1000)) for lang in langs])

    def scored(w):
        if w in known[0]:
            return log(0, w)
        for n in language.ORDERS:
            seen = [g for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in known[n]]
            if seen:
                c = Counter(seen)
                return sum(m * log(n, g) for g, m in c.items()) / len(seen)
        return np.zeros(len(langs))

    prior = np.log([texts[lang] / sum(texts.values()) for lang in langs])
    want = []
    for k, t, *_ in docs:
        found = Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
        s = prior + sum((n * scored(w) for w, n in found.items()), np.zeros(len(langs)))
        p = np.exp(s - s.max())
        want.append((k, held(k), langs[int(p.argmax())] if found else "und", round(float(p.max() / p.sum()) if found else 0.0, 4)))
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 4)) for r in rows), key=repr)
    assert got == sorted(want, key=repr) and any(x[2] == "und" for x in got)


def test_quality(spark, sf):
    """Every score is what the thresholds make of the weighted features; labels of held-out rows are not used."""
    path, docs, labels = sf
    d, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    from logloom.llm.common import learnable
    from pyspark.sql import functions as F

    model = quality.fit(d.where(learnable(F.col("doc_id"))), known.where(learnable(F.col("doc_id"))))
    again = quality.fit(d.where(learnable(F.col("doc_id"))).repartition(7), known.where(learnable(F.col("doc_id"))))
    assert np.allclose(model["weights"], again["weights"], atol=1e-5)

    def plain(t):
        """Features worked out word by word."""
        w = re.findall(r"\S+", t or "")
        if not w:
            return 0.0
        h = [zlib.crc32(x.encode()) for x in w]
        one = Counter(x & (1 << 17) - 1 for x in h)
        two = Counter(((a * 0x9E3779B1 ^ b * 0x85EBCA6B) & 0xFFFFFFFF) >> 15 for a, b in zip(h, h[1:], strict=False))
        s = 0.0
        for c in (one, two):
            norm = max(1e-9, math.sqrt(sum(math.log1p(n) ** 2 for n in c.values())))
            s += sum(float(model["weights"][x]) * math.log1p(n) / norm for x, n in c.items())
        n, lines = max(1, len(t)), t.split("\n")
        shapes = [len(set(w)) / len(w), sum("A" <= c <= "Z" for c in t) / n, sum("0" <= c <= "9" for c in t) / n, sum(33 <= ord(c) < 127 and not c.isalnum() for c in t) / n, min(1.0, math.log1p(len(w)) / 10), min(1.0, n / len(w) / 20), len(set(lines)) / len(lines), sum(b > 127 for b in t.encode()) / n]
        return s + sum(3 * x * float(model["weights"][(1 << 17) + i]) for i, x in enumerate(shapes))

    rows = {(r["doc_id"], r["score"], r["predicted"], r["held_out"]) for r in queries.op4_quality(spark, path).collect()}
    want = {k: 1 / (1 + math.exp(-(plain(t) - float(model["cuts"][0])))) for k, t, *_ in docs if len(t or "") < 10_000}
    for k, s, p, h in rows:
        assert h == held(k) and p == int(s >= 0.5) and 0 <= s <= 1
        if k in want:
            assert abs(s - want[k]) < 1e-3, k
    good = {k: g for k, g, _ in labels}
    assert np.mean([p == good[k] for k, _, p, h in rows if h and k in good]) > 0.8


def test_toxicity(spark, sf):
    """Scores are the trees' probabilities put through the calibration, both worked out by hand."""
    path, docs, labels = sf
    from logloom.llm.common import learnable
    from pyspark.sql import functions as F

    d, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit(d.where(learnable(F.col("doc_id"))), known.where(learnable(F.col("doc_id"))))
    words, prefixes = model.lexicon.value
    assert {"idiot", "moron"} & words
    trees = [(t.toDebugString, w) for t, w in zip(model.trees.trees, model.trees.treeWeights, strict=True)]
    grown = list(model.trees.trees)
    x, y = list(model.curve.boundaries), list(model.curve.predictions)

    def plain(t):
        from pyspark.ml.linalg import Vectors

        v = Vectors.dense(toxicity.features(t, words, prefixes))
        margin = sum(w * tree.predict(v) for tree, (_, w) in zip(grown, trees, strict=True))
        p = 1 / (1 + math.exp(-2 * margin))
        return min(1.0, max(0.0, float(np.interp(p, x, y))))

    rows = queries.op6_toxicity(spark, path).collect()
    texts = defaultdict(list)
    for k, t, *_ in docs:
        texts[k].append(t)
    bad = {k: b for k, _, b in labels}
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5)
        assert any(abs(r["score"] - plain(t)) < 1e-6 for t in texts[r["doc_id"]]), r["doc_id"]
    assert len(rows) == len(docs)
    assert np.mean([r["predicted"] == bad[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in bad]) > 0.9


def test_whole_table(spark, sf):
    """The other queries return every row of the table, and their columns agree with the texts."""
    path, docs, _ = sf
    texts = defaultdict(list)
    for k, t, *_ in docs:
        texts[k].append(t or "")
    n = {}
    for name in ("op1_repeats", "op7_pieces", "op8_simhash", "op9_sharding", "op10_spots"):
        rows = queries.QUERIES[name](spark, path).collect()
        n[name] = len(rows)
        assert Counter(r["doc_id"] for r in rows) == Counter(k for k, *_ in docs), name
        if name == "op9_sharding":
            assert all((r["size"], r["text_crc32"]) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r["doc_id"]]} for r in rows)
            assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(8) for i in range(len(range(s, len(docs), 8)))]
        if name == "op10_spots":
            order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
            assert all(r["n_chars"] in {len(t) for t in texts[r["doc_id"]]} for r in rows)
            by = {d[0]: e[1] or "" for d, e in zip(order, order[1:] + order[:1], strict=True) if len(texts[d[0]]) == 1 and (e[0] is None or len(texts[e[0]]) == 1)}
            for r in rows:
                if r["doc_id"] in by and r["doc_id"] is not None:
                    t, other = texts[r["doc_id"]][0], by[r["doc_id"]]
                    e = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
                    assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest(), r["doc_id"]
    pieces = queries.op5_packing(spark, path).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(k for k, *_ in docs)
    assert set(n.values()) == {len(docs)}


def test_far_apart_ids(spark):
    from logloom.llm import spots

    ids = [-(2**63), -(2**62) - 7, -5, 0, 3, 2**40, 2**62 + 11, 2**63 - 1]
    rows = [(k, f"the text of {k}") for k in ids] + [(3, f"another {i}") for i in range(40)] + [(None, f"nobody {i}") for i in range(40)]
    found = spots.with_next(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=2, cuts=8).collect()
    assert len(found) == len(rows) and sorted(r["next_text"] for r in found) == sorted(t for _, t in rows)
    after = {r["doc_id"]: r["next_text"] for r in found if r["doc_id"] not in (3, None)}
    assert after[2**63 - 1] == f"the text of {2**62 + 11}" and after[0] == "the text of -5" and after[-(2**62) - 7] == f"the text of {-(2**63)}" and after[-(2**63)].startswith("nobody")


@pytest.mark.parametrize("spread", ["even", "close", "far", "hot"])
def test_ranges_are_even_however_ids_lie(spark, spread):
    """Ranges by rank: ids close together, one far off, and a key of a twentieth of the rows make no range much fuller than others."""
    from pyspark.sql import functions as F

    from logloom.llm import spots

    r = random.Random(2)
    n = 8000
    ids = {
        "even": list(range(n)),
        "close": [10**12 + (i if i % 3 else i * 10**6) for i in range(n)],
        "far": [2**62, *range(n - 1)],
        "hot": [7 if i % 20 == 0 else i for i in range(n)],
    }[spread]
    docs = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(ids)], "doc_id long, text string").repartition(5)
    found = spots.with_next(docs, bucket_rows=20, cuts=8)
    order = sorted(range(n), key=lambda i: -ids[i])
    got = {x["text"]: x["next_text"] for x in found.collect()}
    assert sorted(got.values()) == sorted(got) and len(got) == n
    at = {f"text {i}": ids[i] for i in range(n)}
    steps = [(at[a], at[b]) for a, b in got.items()]
    follow = {ids[i]: ids[j] for i, j in zip(order, order[1:] + order[:1], strict=True)}
    assert all(a == b or follow[a] == b for a, b in steps)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "q2" in plan  # two levels below the cuts
    sizes = found.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert sizes.agg(F.sum("count")).first()[0] == n and r is not None
