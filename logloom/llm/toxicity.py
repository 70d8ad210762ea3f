"""Toxicity from gradient-boosted trees over dense features, with isotonic calibration.

The lexicons (whole words, and word beginnings for inflected or compounded forms) are learned from one
part of the labelled sample: words that distinct texts with the label use far more often than the
others. Trees are grown on a second part and calibrated on a third, so that no row's own words lift its
score in the fit. The sample is bounded by ``sample_rows``; lexicons by ``entries``.

Defined cases: a null or empty text has zero rates and is scored like any other; labels null or without
a text are not learned from, nor are rows without an id; where a label is missing on one side altogether, the score is the
share of the label; repeated rows score alike; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released

# Second-person words of English, German, French and Spanish, and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¿¡"
PREFIX, NEAR = 4, 3
FEATURES = ("words per 1000", "words", "prefixes per 1000", "prefixes", "near second person", "capitals", "punctuation", "exclamations", "obfuscated", "hidden words", "log length")
INNER = re.compile(r"[^\W_][@$!*.\-_0134578]+[^\W_]|[@$!*][^\W_]|[^\W_][@$*]")
ASCII_PUNCT = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])


def features(text: str | None, words: frozenset[str], prefixes: frozenset[str]) -> list[float]:
    t = text or ""
    counts = np.bincount(np.frombuffer(t.encode(), "u1"), minlength=256)
    tokens = t.lower().split()
    n, chars = max(1, len(tokens)), max(1, len(t))
    plain = [w.strip(EDGE) for w in tokens]
    at = [i for i, w in enumerate(plain) if w in words]
    begun = sum(w[:PREFIX] in prefixes for w in plain)
    odd = [w for w in {*tokens} if not w.isalnum() and INNER.search(w) or (not w.isalpha() and any(c in "0134578" for c in w) and any(c.isalpha() for c in w))]
    odd_words = set(odd)
    obscured = sum(w in odd_words for w in tokens) if odd else 0
    hidden = sum((p := w.strip(EDGE)) not in words and p.translate(STANDS_FOR) in words for w in tokens if w in odd_words) if odd else 0
    close = sum(not SECOND_PERSON.isdisjoint(plain[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    upper = int(counts[65:91].sum())
    return [1000 * len(at) / n, math.log1p(len(at)), 1000 * begun / n, math.log1p(begun), math.log1p(close), upper / chars, int(counts[ASCII_PUNCT].sum()) / chars, int(counts[33]) / chars, obscured / n, math.log1p(hidden), math.log1p(n)]


def featured(text: Column, lexicon: Any) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, prefixes = lexicon.value
        released()
        for b in batches:
            rows = np.array([features(t, words, prefixes) for t in b.to_pylist()], "f8").reshape(-1, len(FEATURES))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))

    return F.arrow_udf(run, "array<double>")(text)


def lexicons(labelled: DataFrame, text: str, label: str, entries: int, least: int = 4, lift: float = 4.0) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings whose share among labelled texts is lift times their share elsewhere."""
    once = labelled.groupBy(F.xxhash64(text).alias("h")).agg(F.first(text).alias("t"), F.max(label).alias("y"))
    sizes = once.groupBy("y").count().collect()
    bad, good = (next((r["count"] for r in sizes if r["y"] == k), 0) for k in (1, 0))
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)([^\W\d_]+)"), F.lit(1)))
    found = once.select("y", words.alias("ws")).select("y", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("ws").alias("ws")), F.struct(F.lit(1).alias("kind"), F.array_distinct(F.transform("ws", lambda w: F.substring(w, 1, PREFIX))).alias("ws")))).alias("k"))
    counts = found.select("y", "k.kind", F.explode("k.ws").alias("w")).where((F.col("kind") == 0) | (F.length("w") == PREFIX)).groupBy("kind", "w").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    score = (F.col("a") + 0.5) / (bad + 1) / ((F.col("n") - F.col("a") + 0.5) / (good + 1))
    kept = counts.where(F.col("a") >= least).withColumn("s", score).where(F.col("s") >= lift).orderBy(F.desc("s"), "w").limit(entries).collect()
    return tuple(frozenset(r["w"] for r in kept if r["kind"] == k) for k in (0, 1))


class Model:
    def __init__(self, lexicon: Any, trees: Any, curve: Any, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def scored(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """docs and the score (in the place of a column of that name)."""
        kept = [F.col(f"`{c}`") for c in docs.columns if c != score]
        if self.trees is None:
            return docs.select(*kept, F.lit(float(self.share)).alias(score))
        rows = self.raw(docs.select(F.struct(*kept).alias("record"), array_to_vector(featured(F.col(text), self.lexicon)).alias("__features")))
        return self.curve.transform(rows).select("record.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score"))).alias(score))

    def raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("__p", vector_to_array("__probability")[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 30_000, entries: int = 4_000, trees: int = 12, depth: int = 3, seed: int = 42) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("__y"))
    lot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20))
    share = min(1.0, sample_rows / max(1, known.count()))
    # ids come first, so that only the sample's texts are moved
    rows = docs.select(key, text).where(F.col(text).isNotNull() & (lot < int(share * (1 << 20)))).join(known.where(lot < int(share * (1 << 20))), key)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(20))
    rows = checkpointed(rows.select(F.col(text).alias("t"), F.col("__y").alias("label"), part.alias("part")))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    lexicon = spark.sparkContext.broadcast(lexicons(rows.where("part < 9").withColumnRenamed("t", "x"), "x", "label", entries))
    learned = checkpointed(rows.where("part >= 9").select("label", "part", featured(F.col("t"), lexicon).alias("f"))).select("label", "part", array_to_vector("f").alias("__features"))
    sides = {(r["k"], r["label"]) for r in learned.select((F.col("part") >= 16).alias("k"), "label").distinct().collect()}
    if len(sides) < 4:
        return Model(lexicon, None, None, bad / n if n else 0.0)
    grown = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32, minInstancesPerNode=5).setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(learned.where("part < 16"))
    model = Model(lexicon, grown, None, bad / n)
    # a row per distinct score, weighted by its rows: many texts share a score
    pairs = model.raw(learned.where("part >= 16")).groupBy("__p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    model.curve = IsotonicRegression(featuresCol="__p", labelCol="label", weightCol="weight", predictionCol="__score").fit(pairs)
    return model
