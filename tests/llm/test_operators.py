"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import components, language, packing, pieces, quality, repeats, sharding, simhash, spots, toxicity

SCHEMA = "doc_id long, text string, bucket string, __x int, size long, lang string"
PASSAGE = "the same long passage of words that several of the documents share, word for word, ü and all "
rng = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "größe", "日本", "x,", "Idiot!"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


ROWS = [
    (1, "shared " + PASSAGE + prose(20, 1)),
    (2, prose(5, 2) + PASSAGE + prose(9, 3) + PASSAGE),
    (3, None),
    (4, ""),
    (5, " \n\t  "),
    (6, "!!! ???"),
    (7, prose(4000, 4)),
    (8, prose(60, 5)),
    (9, prose(60, 5)),
    (10, prose(59, 5) + " other"),
    (11, "a" * 300),
    (12, "a" * 200 + "b"),
    (13, "日本語のテキスト" * 20),
    (8, prose(60, 5)),
    (None, prose(60, 5)),
    (14, "one two"),
]
DOCS = [(k, t, "b", 1, 5, None) for k, t in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(rows, length):
    """Brute force: (key, text) to (key, kept bytes, removed runs)."""
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if k is not None:
                first[b[p : p + length]] = min(k, first.get(b[p : p + length], k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if k is not None and first[b[p : p + length]] < k:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        out.append((k, bytes(np.frombuffer(b, "u1")[~gone]), len(edge) // 2))
    return out


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_repeats(docs, empty, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    found = repeats.without_repeats(docs, chunk_bytes=2000, bucket_entries=64)
    assert found.columns == ["record", "kept", "spans"] and found.select("record.*").columns == docs.columns
    assert sorted(((r["record"]["doc_id"] or 0, bytes(r["kept"]), len(r["spans"])) for r in found.collect())) == sorted((k or 0, b, n) for k, b, n in cut(ROWS, 50))
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_random(spark):
    r = random.Random(3)
    for length, gram in ((50, 20), (8, 3), (300, 20)):
        parts = ["".join(r.choice("ab") for _ in range(r.randrange(5, 90))) for _ in range(12)] + ["".join(r.choice("abc") for _ in range(700))]
        rows = [(k, "".join(r.choice(parts) for _ in range(r.randrange(6)))) for k in range(40)]
        found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, gram=gram, chunk_bytes=700, bucket_entries=16)
        assert sorted((x["record"]["doc_id"], bytes(x["kept"]), len(x["spans"])) for x in found.collect()) == cut(rows, length)


def test_language(spark, empty):
    rows = [(k, f"{'der hund und die katze' if k % 2 else 'the dog and the cat'} {k}", "de" if k % 2 else "en") for k in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train)
    ask = spark.createDataFrame([("die katze",), ("cats and dogs",), (None,), ("",), ("12 !!",), ("hunde",)], "t string")
    found = [(r["p"]["lang"], r["p"]["score"]) for r in ask.select(language.predicted(F.col("t"), model, spark).alias("p")).collect()]
    assert [x for x, _ in found] == ["de", "en", "und", "und", "und", "de"]
    assert all(0 <= s <= 1 for _, s in found)
    nothing = language.fit(empty)
    assert ask.select(language.predicted(F.col("t"), nothing, spark).alias("p")).where("p.lang <> 'und'").count() == 0


def test_words_are_learned_as_they_are_scored(spark, empty):
    """Marks belong to their word; what is no letter is no word."""
    hi, en = "नमस्ते दुनिया में किताब पढ़ना", "well ½ naïve cafe\u0301 o'clock"
    model = language.fit(spark.createDataFrame([(k, (hi, en)[k % 2], ("hi", "en")[k % 2]) for k in range(40)], "doc_id long, text string, lang string"))
    known = set(model["entries"][0][0].split("\n"))
    assert known == {*hi.split(), "well", "naïve", "cafe\u0301", "o", "clock"} == set(language.words_of(f"{hi} {en}"))
    text = "".join(map(chr, [*range(0x20, 0x530), *range(0x900, 0x980), *range(0x4E00, 0x9FF0), *range(0xAC00, 0xD7A4)]))
    assert language.words_of(text) == spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(language.WORD), F.lit(1))).first()[0]
    for t in (x for _, x in ROWS if x):
        assert language.words_of(t) == language.LETTERS.findall(t)
    ask = spark.createDataFrame([("दुनिया",), ("½ ²",), ("\u0301",), ("12 \u0301 ٣",), ("cafe\u0301",), ("ª",)], "t string")
    found = [(r["p"]["lang"], r["p"]["score"] > 0) for r in ask.select(language.predicted(F.col("t"), model, spark).alias("p")).collect()]
    assert found[:5] == [("hi", True), ("und", False), ("und", False), ("und", False), ("en", True)] and found[5][0] != "und"
    # a tie goes to the smaller name
    tie = language.fit(spark.createDataFrame([(k, "same words", ("b", "a")[k % 2]) for k in range(4)], "doc_id long, text string, lang string"))
    assert {r["p"]["lang"] for r in ask.select(language.predicted(F.lit("same"), tie, spark).alias("p")).collect()} == {"a"}


def test_quality(spark, docs):
    r = random.Random(5)
    rows = [(k, k % 4) for k in range(800)]
    texts = [(k, " ".join(r.choice(["good", "fine", "word"] if r.random() < g / 3 else ["junk", "spam", "word"]) for _ in range(30))) for k, g in rows]
    t, g = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*rows, (5, None)], "doc_id long, quality int")
    model = quality.fit(t.where("doc_id < 600"), g)
    assert model["grades"] == [0, 1, 2, 3] and list(model["cuts"]) == sorted(model["cuts"])
    held = t.where("doc_id >= 600").select("doc_id", quality.graded(F.col("text"), model, spark).alias("g")).toPandas()
    truth = held.doc_id % 4
    assert np.corrcoef(held.g.map(lambda x: x["expected"]), truth)[0, 1] > 0.9
    assert ((held.g.map(lambda x: x["tail"]) >= 0.5) == (truth >= 2)).mean() > 0.85
    one = quality.fit(docs, g.where("quality = 1").limit(0))
    assert {r["g"]["expected"] for r in docs.select(quality.graded(F.col("text"), one, spark).alias("g")).collect()} == {0.0}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(spark, docs, empty, tokenizer):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces_ = packing.pack(docs, *paths, window=64).toPandas().sort_values(["sequence_id", "offset"])
    stream = np.concatenate([np.frombuffer(x, "<u4") for x in pieces_.ids])
    place = pieces_.sequence_id * 64 + pieces_.offset
    assert list(place) == list(np.cumsum(pieces_.length) - pieces_.length) and len(stream) == pieces_.length.sum()
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in ROWS)
    got, now = [], []
    for p in pieces_.itertuples():
        assert p.start == len(now)
        now += np.frombuffer(p.ids, "<u4").tolist()
        if len(now) == p.doc_tokens:
            got.append(now)
            now = []
    assert sorted(got) == want and not now
    assert packing.pack(empty, *paths).count() == 0


def test_word_tokenizer(tokenizer):
    tok = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["a", "the", " ", "  ", "\n", "\n ", "'s", "12", "é", "日", "<|endoftext|>", "!", "\t", " ", "😀", ". "]) for _ in range(r.randrange(12)))
        assert np.frombuffer(tok.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_toxicity(spark, docs, empty):
    r = random.Random(9)
    rows = []
    for k in range(900):
        bad = k % 3 == 0
        w = [r.choice(["calm", "tree", "river", "stone", "walk", "you"]) for _ in range(40)]
        if bad:
            w[r.randrange(40)] = r.choice(["idiot", "moron", "scum"])
        rows.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 700").select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = model.scored(df.where("doc_id >= 700")).toPandas()
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.97 and held.score.between(0, 1).all()
    odd = model.scored(docs)
    assert odd.columns == [*docs.columns, "score"] and odd.where("score IS NULL").count() == 0 and odd.count() == len(ROWS)
    assert model.scored(empty).count() == 0
    none = toxicity.fit(docs, df.select("doc_id", "toxic").limit(0))
    assert {x["score"] for x in none.scored(docs).collect()} == {0.0}


def test_pieces(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    both = docs.select("text", pieces.round_trip(F.col("text"), path).alias("p"), pieces.encoded(F.col("text"), path).alias("e"))
    for row in both.select("*", pieces.decoded(F.col("e"), path).alias("d")).collect():
        ids = sp.encode(row["text"] or "", add_eos=True)
        assert row["p"]["ids"] == row["e"] == ids and row["p"]["decoded"] == row["d"] == sp.decode(ids)
    m = pieces.model(path)
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["a", "the", "ing", " ", "  ", "▁", "\n", "é", "日", "𝒳", "<s>", "</s>", "<0x0A>", "<unk>", "!!!!", "aaaa", "0", "\x00", "==", "--"]) for _ in range(r.randrange(14)))
        assert m.encode(t).tolist() == sp.encode(t, add_eos=True) and m.decode(sp.encode(t)) == sp.decode(sp.encode(t)), repr(t)
        ids = [r.randrange(sp.vocab_size()) for _ in range(4)] + [r.randrange(3, 259) for _ in range(r.randrange(5))]
        if 0 not in ids:
            assert m.decode(ids) == sp.decode(ids), ids


def naive_classes(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


@pytest.mark.parametrize("full", [128, 1])
def test_simhash_links(spark, full):
    r = random.Random(4)
    fps = {0, -1, 1, 3}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(6):
            fps.add((x := x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) - (1 << 64 if x >> 63 else 0))
    rows = [(f, k) for k, f in enumerate(sorted(fps))]
    links = simhash.linked(spark.createDataFrame(rows, "fp long, node long"), full)
    comp = {x["node"]: x["component"] for x in components.components(links).collect()}
    fp = {k: f & (2**64 - 1) for f, k in rows}
    want = naive_classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {k: comp.get(k, k) for k in fp} == want


def test_simhash(docs, empty):
    import xxhash

    def plain(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").split() if t else []
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    found = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["fp"] & (2**64 - 1)) for r in found) == sorted((k or 0, plain(t)) for k, t in ROWS)
    by = {r["doc_id"]: r["component"] for r in found}
    assert by[3] == by[4] == by[5] == 3 and by[9] == 8 and by[None] == 8 and by[7] == 7
    assert simhash.near_duplicates(empty).count() == 0


def test_sharding(docs, empty):
    found = sharding.external_shuffle(docs, bucket_bytes=400, shards=3).collect()
    assert sorted((r["record"]["doc_id"] or 0, r["record"]["text"] or "") for r in found) == sorted((k or 0, t or "") for k, t in ROWS)
    for s in range(3):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["shard"] == s for r in found) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1
    assert all(r["size"] == len((r["record"]["text"] or "").encode()) + 1 for r in found)
    assert len({r["bucket"] for r in found}) > 1
    assert sharding.external_shuffle(empty).count() == 0


def test_sharding_is_the_same_under_other_partitions(spark, tmp_path):
    rows = [(k % 150, prose(k % 37, k % 150), "x") for k in range(400)] + [(7, "the same long text " * 9, "x")] * 60
    found = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = sharding.external_shuffle(spark.createDataFrame(rows, "doc_id long, text string, shard string").coalesce(1), bucket_bytes=1500, task_buckets=3)
        found.append(sorted((r["position"], r["shard"], r["slot"], r["record"]["doc_id"], r["record"]["text"]) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and [x[0] for x in found[0]] == list(range(460))
    assert max(sum(r["n"] for r in [x]) for x in df.where("record.doc_id = 7 AND length(record.text) > 160").groupBy("bucket").agg(F.count("*").alias("n")).collect()) < 40
    sharding.write(df, str(tmp_path / "shards"))
    for s in range(8):
        back = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "shards" / f"__shard={s}")).orderBy("__slot").collect()]
        assert back == [x[3] for x in sorted(found[0], key=lambda x: x[2]) if x[1] == s]


def signatures(t):
    import re

    t = (t or "").lower()
    w = [x for x in re.split(r"[^\w]+|_", t) if x]
    content, out = [], set()
    content = [x for x in w if x not in spots.COMMON]
    seen = 0
    for x in w:
        if x in spots.COMMON:
            if seen + 1 < len(content):
                out.add(f"{x} {content[seen]} {content[seen + 1]}")
        else:
            seen += 1
    return sorted(out, key=str.encode) or [t]


def test_spots(docs, empty):
    rows = docs.select("doc_id", "text", spots.signatures(F.col("text")).alias("s"), spots.digest(spots.signatures(F.col("text"))).alias("d")).collect()
    for r in rows:
        assert r["s"] == signatures(r["text"])
        assert r["d"] == hashlib.sha256("\n".join(r["s"]).encode()).hexdigest()
    follow = spots.with_next(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), bucket_rows=2, cuts=3).select("*", spots.edited(F.col("text"), F.col("next_text")).alias("e")).collect()
    text = {k: t or "" for k, t in ROWS if k is not None}
    ids = sorted(text, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert len(follow) == len(ids)
    for r in follow:
        t, n = text[r["doc_id"]], text[after[r["doc_id"]]]
        assert r["next_text"] == n and r["e"] == t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    assert spots.with_next(docs).count() == len(ROWS) and spots.with_next(empty).count() == 0


def test_spot_pairs(spark):
    r = random.Random(6)
    rows = []
    for k in range(20):
        base = [r.choice(WORDS) + str(r.randrange(99)) if r.random() < 0.6 else r.choice(["the", "of", "and"]) for _ in range(120)]
        rows.append((10 * k, " ".join(base)))
        for c in range(3):
            for _ in range(c):
                base[r.randrange(120)] = "changed" + str(c)
            rows.append((10 * k + 1 + c, " ".join(base)))
    members, links = spots.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    cls = {x["doc_id"]: x["class"] for x in members.collect()}
    sets = {k: set(signatures(t)) for k, t in rows}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    reps = sorted(set(cls.values()))
    assert {(x["a"], x["b"]) for x in links.collect()} == {(a, b) for a in reps for b in reps if a < b and jac(a, b) >= 0.8}
    assert all(sets[k] == sets[c] for k, c in cls.items())
