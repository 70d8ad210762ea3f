"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from .test_near import sets, smallest
from .test_operators import cut

EN, DE = "river stone walk calm tree house garden window".split(), "der hund und die katze mit dem haus".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    docs, labels = [], []
    for k in range(260):
        lang = "de" if k % 4 == 0 else "en"
        words = [r.choice(DE if lang == "de" else EN) + str(r.randrange(60)) for _ in range(50)]
        bad = k % 5 == 1
        if bad:
            words[r.randrange(50)] = r.choice(["idiot", "moron"])
        docs.append((k, " ".join(words), lang, "s", 1))
        labels.append((k, 1, int(bad)))
    docs += [(300, docs[0][1], "de", "s", 1), (301, docs[2][1][:200] + " and more words that no one else has said so far", "en", "s", 1), (302, None, None, None, None), (303, "", "en", "s", 0), (304, "12 !!", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, {k for k, _, bad in labels if bad}


def test_stages(spark, corpus):
    from tokenizers import Tokenizer

    path, docs, bad = corpus
    df = spark.read.parquet(f"{path}/documents.parquet")
    columns, text = df.columns, {d[0]: d[1] for d in docs}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "language", "simhash", "repeats", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        df = stage(spark, df, path)
        df.write.parquet(f"{path}/out-{k}")
        df = spark.read.parquet(f"{path}/out-{k}")
        seen[name] = {r["doc_id"]: r for r in df.collect()} if k < 4 else df.collect()
        if k < 4:
            assert df.columns == columns
    clean = set(text) - bad
    kept = set(seen["toxicity"])
    assert len(kept & bad) <= 0.05 * len(bad) and len(clean - kept) <= 0.02 * len(clean)
    assert set(seen["language"]) == kept - {302, 303, 304}
    label = smallest(sets([(k, text[k]) for k in seen["language"]]))
    assert set(seen["simhash"]) == {k for k, c in label.items() if k == c} and 300 not in seen["simhash"]
    want = {k: b.decode() for k, b, _ in cut(sorted((k, text[k]) for k in seen["simhash"]), 50)}
    assert {k: r["text"] for k, r in seen["repeats"].items()} == want
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by: dict[int, list] = {}
    for r in sorted(seen["packing"], key=lambda r: (r["doc_id"], r["start"])):
        by.setdefault(r["doc_id"], []).append(r)
    for k, rows in by.items():
        ids = np.array(tok.encode(want[k], add_special_tokens=False).ids + [0], "<u4")
        assert sum(r["length"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
    assert set(by) == set(want)


def test_empty(spark, corpus, tmp_path):
    path = corpus[0]
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_cuts_leave_whole_characters(spark):
    """Cuts through characters; U+FFFD of the source stays; very long texts, and tables without a count of characters."""
    one = "größe \ufffd 日本語のテキストをここに置く、そして続ける 😀 and a passage that is long enough to count, by far"
    rows = [(1, "start " + one), (2, "\ufffd other words " + one[3:] + " tail \ufffd"), (3, "ü" * 80), (4, "xü" + "ü" * 79 + "é"), (5, "word " * 200_000), (6, "a" + "word " * 100_000), (7, None)]
    left = pipeline.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert got[1] == rows[0][1] and got[2] == "\ufffd other words  tail \ufffd" or got[2].startswith("\ufffd other words") and got[2].endswith(" tail \ufffd")
    assert got[4] in ("xé", "x") and got[7] is None and got[5] == rows[4][1] and len(got[6]) < 60


def test_near_duplicates_by_row(spark):
    """Ids that repeat, copies of whole rows, rows without an id, and columns of the operators' own names."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (None, None), (3, ""), (None, "only here in all of the table")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "r", "k", 7) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, record string, k string, a int")
    left = pipeline.one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, rows[-1][1]), (1, a), (2, b), (3, "")]


def test_clashing_names(spark, corpus, tmp_path):
    """Every stage keeps columns of any name, rows without an id, and repeated rows."""
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for c in ("kept", "spans", "record", "found", "score", "__chunk", "__p", "part"):
        docs = docs.withColumn(c, docs["doc_id"] % 3)
    docs = docs.union(docs.where("doc_id = 2").withColumn("doc_id", docs["doc_id"] * None))
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() > 100, name
