"""SpotSigs document fingerprints.

A common word is an anchor; with the two content words that follow it, it makes a signature. The set of a
text's signatures is its fingerprint (shown as the digest of the sorted set), the likeness of two
fingerprints the Jaccard similarity of the sets. Only built-in functions run.

near_pairs() compares whole corpora: equal sets are one class; classes are partitioned by set length so
that only neighbouring partitions can reach the threshold, candidates share one of the rarest signatures
of both (as many as the threshold leaves), and lengths prune before sets are compared.

Defined cases: a null text is like an empty one; a text without a signature (too short, or without a
common word) has one, the text itself in lower case; equal texts have equal fingerprints; repeated rows
are fingerprinted as often as they come, and rows that repeat an id follow each other in the order of
their texts' hashes; rows without an id come last; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

# Common words of English, German, French and Spanish.
COMMON = (
    "the of to and in is was it an a that at are be on he by with for as this or from not "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les de et un une du en que est pour dans qui sur par pas avec "
    "el y los del se las por con no una su al para lo"
).split()
MOST_PARTS = 4096
WORD_BREAK = r"[^\p{L}\p{N}]+"


def signatures(text: Column, common: Sequence[str] = COMMON) -> Column:
    """array<string>: the sorted distinct signatures.

    The j-th anchor at word i has i - j content words before it, so content word i - j follows it."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    common = list(dict.fromkeys(common))

    def of(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(common))
        anchors = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), F.struct(i.alias("i"), w.alias("w")))), lambda a: a.isNotNull())
        return F.transform(F.array(F.struct(content.alias("c"), anchors.alias("a"))), lambda p: F.transform(F.filter(p["a"], lambda a, j: a["i"] - j + 1 < F.size(p["c"])), lambda a, j: F.concat_ws(" ", a["w"], F.get(p["c"], a["i"] - j), F.get(p["c"], a["i"] - j + 1))))[0]

    words = F.filter(F.split(lower, WORD_BREAK), lambda w: w != "")
    found = F.transform(F.array(words), of)[0]
    found = F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(F.array(lower)))
    return found[0]


def digest(sigs: Column) -> Column:
    return F.sha2(F.array_join(sigs, "\n"), 256)


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = 2000, cuts: int = 64) -> DataFrame:
    """key, text and next_text: the text of the row with the next smaller key (after the last: the first's).

    Rows are dealt into ranges of about bucket_rows by rank: cuts of the whole table first, then parts of each cut,
    then parts of those, so that keys that lie close together make as many ranges as others. Each range is sorted by
    itself; the first row of the range that follows is added at the end of each, so that texts move once. Rows
    without a key, and those of a key that fills more than a range, are dealt into ranges of their texts' hash."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n, known, points = rows.agg(F.count("*"), F.count("k"), F.percentile_approx("k", [i / cuts for i in range(1, cuts)], 10_000)).first()
    kind = rows.schema["k"].dataType
    share = F.col("h").cast("double") / 2.0**64 + 0.5

    def placed(points: Column) -> tuple[Column, Column]:
        """The part of k between points, and into how many its rows are dealt by hash: a point that comes m times is a key of m parts."""
        below, equal = F.size(F.filter(points, lambda p: p < F.col("k"))), F.size(F.filter(points, lambda p: p == F.col("k")))
        return F.when(equal >= 2, below).otherwise(below + equal), F.when(equal >= 2, equal)

    fine = max(1, math.ceil(known / bucket_rows / cuts))
    parts = [fine] if fine <= cuts else [cuts, min(MOST_PARTS, math.ceil(fine / cuts))]
    top = F.array(*[F.lit(str(p)).cast(kind) for p in points or []]) if known else F.array().cast(f"array<{kind.simpleString()}>")
    part, times = placed(top)
    size = F.when(times.isNotNull(), times * fine).when(F.col("k").isNull(), max(1, math.ceil((n - known) / bucket_rows))).otherwise(1)
    dealt = rows.withColumn("q0", F.when(F.col("k").isNull(), -1).otherwise(part)).withColumn("pieces", size)
    names = ["q0"]
    for i, m in enumerate(parts, 1):
        # one row for each part so far, of m points: cuts and parts bound both
        inner = dealt.where("k IS NOT NULL AND pieces = 1").groupBy(*names).agg(F.percentile_approx("k", [j / m for j in range(1, m)], 1000).alias("points")) if m > 1 else None
        if inner is None:
            dealt = dealt.withColumn(f"q{i}", F.lit(0))
        else:
            below, equal = placed(F.col("points"))
            # a key of several parts is the greatest of the part it stands in, and stays behind the others there
            inside = F.col("k").isNotNull() & (F.col("pieces") == 1) & F.col("points").isNotNull()
            dealt = dealt.join(F.broadcast(checkpointed(inner)), names, "left").withColumn(f"q{i}", F.when(inside, below).when(F.col("k").isNotNull() & (F.col("pieces") > 1), m).otherwise(0)).withColumn("pieces", F.when(inside & equal.isNotNull(), equal * math.prod(parts[i:])).otherwise(F.col("pieces"))).drop("points")
        names.append(f"q{i}")
    dealt = dealt.select("k", "t", "h", F.struct(*[F.col(c).cast("long").alias(c) for c in names], F.least(F.floor(share * F.col("pieces")), F.col("pieces") - 1).cast("long").alias("s")).alias("r"), F.lit(0).alias("added"))
    place = F.struct(F.coalesce(F.col("k").cast("long"), F.lit("-9223372036854775808").cast("long")), "h")
    heads = checkpointed(dealt.groupBy("r").agg(F.max_by("t", place).alias("t")))
    # the range before each: within blocks of ranges, then between blocks
    block = F.col("r.q0") * MOST_PARTS + F.col("r.q1")
    ranges = heads.select("r", block.alias("block"))
    tops = ranges.groupBy("block").agg(F.max("r").alias("top"))
    tops = tops.select("block", F.lag("top").over(W.orderBy("block")).alias("below"), F.max("top").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last"))
    lower = ranges.select("r", "block", F.lag("r").over(W.partitionBy("block").orderBy("r")).alias("lower")).join(tops, "block")
    # after the smallest row comes the greatest one
    ring = lower.select(F.coalesce("lower", "below", "last").alias("smaller"), "r")
    ends = heads.withColumnRenamed("r", "smaller").join(ring, "smaller").select(F.lit(None).cast(kind).alias("k"), "t", F.lit(None).cast("long").alias("h"), "r", F.lit(1).alias("added"))
    down = W.partitionBy("r").orderBy("added", F.desc_nulls_last("k"), F.desc("h"))
    return dealt.unionByName(ends).select("k", "t", "added", F.lead("t").over(down).alias("next_text")).where("added = 0").select(F.col("k").alias(key), F.col("t").alias(text), "next_text")


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points replaced by as many of the other text's first."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def near_pairs(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): key and class of each row, and pairs of classes (a < b) of a likeness of at least threshold."""
    sets = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), signatures(F.col(text)).alias("s")).withColumn("f", digest(F.col("s")))
    members = checkpointed(sets.select("k", "f"))
    names = members.groupBy("f").agg(F.min("k").alias("class"))
    classes = checkpointed(sets.join(names, (sets.k == names["class"]) & (sets.f == names.f)).dropDuplicates(["k"]).select("class", F.col("s").alias("sigs"), F.size("s").alias("n")))
    exploded = classes.select("class", "n", F.explode("sigs").alias("sig"))
    counts = exploded.groupBy("sig").agg(F.count("*").alias("df"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    rare = exploded.join(counts, "sig").withColumn("at", F.row_number().over(W.partitionBy("class").orderBy("df", "sig"))).where(F.col("at") <= keep)
    # partition p holds set lengths in [t^-p, t^-(p+1)): the threshold is out of reach beyond the next one
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    index = rare.select("class", "n", "sig", part.alias("p"))
    probes = index.select(F.col("class").alias("b"), F.col("n").alias("m"), "sig", F.explode(F.array(F.col("p"), F.col("p") - 1, F.col("p") + 1)).alias("p"))
    near = (F.least("n", "m") >= threshold * F.greatest("n", "m")) & (F.col("class") < F.col("b"))
    pairs = index.join(probes, ["sig", "p"]).where(near).select(F.col("class").alias("a"), "b").distinct()
    x, y = classes.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), classes.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    links = pairs.join(x, "a").join(y, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold).select("a", "b", "likeness")
    return members.join(names, "f").select(F.col("k").alias(key), "class"), links
