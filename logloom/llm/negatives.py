"""Hard negatives: rows of another label whose likeness to an anchor lies in a window below that of a positive.

Both searches are threshold joins (module threshold): the positives of an anchor are its most alike rows of the
same label, and each positive opens a window for negatives. Rows of a label are cut into lots, so a label that
holds a third of all rows is as many meetings as its rows need.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take
no part; vectors of unequal length never meet; rows that repeat an id are rows of their own, and none of them
is a positive or negative of an anchor of that id; ties go to the smaller id; an anchor without positives, or
a window without negatives, gives no rows; components and scores beyond a long end at its limits; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .meetings import scaled, sound
from .threshold import LEAST, MOST, windows_filled


def numbered(vectors: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """row (a number of its own), id, label, d, v (integers)."""
    v = F.col(vector)
    rows = vectors.where(sound(v) & F.col(key).isNotNull() & label.isNotNull())
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.size(v).alias("d"), scaled(v, scale).alias("v")))


def limit(score: Column, hundredths: int, up: bool) -> Column:
    """score * hundredths / 100, rounded towards the inside of a window, exactly."""
    wide = score.cast("decimal(25,0)") * F.lit(hundredths).cast("decimal(4,0)")
    return (F.ceil(wide / 100) if up else F.floor(wide / 100)).cast("decimal(27,0)").cast("long")


def hard_negatives(vectors: DataFrame, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose key is divisible by every. For each anchor and each of its positives the k best rows of
    another label with low/100 * positive_score <= score <= high/100 * positive_score."""
    rows = numbered(vectors, key, F.col(label) if isinstance(label, str) else label, vector, scale)
    anchors = rows.where(F.col("id") % every == 0)
    all_ = F.array(F.struct(F.col("row").alias("window"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    near = windows_filled(anchors.withColumn("windows", all_), rows, positives, same=True)
    near = checkpointed(near.select(F.col("window").alias("anchor"), F.monotonically_increasing_id().alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), limit(F.col("score"), low, True).alias("lo"), limit(F.col("score"), high, False).alias("hi")))
    asked = near.where("lo <= hi").groupBy("anchor").agg(F.collect_list(F.struct("window", "lo", "hi")).alias("windows"))
    found = windows_filled(anchors.join(asked, anchors.row == asked.anchor).drop("anchor"), rows, k, same=False)
    names = near.join(anchors.select("row", F.col("id").alias("anchor_id")), near.anchor == F.col("row")).drop("row")
    return found.join(names, "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
