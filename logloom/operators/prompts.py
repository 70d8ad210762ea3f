"""Logical prompts: originated user events of sessions that a person drives, and where else they were seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def logical(events: DataFrame, resolved: DataFrame, sessions: DataFrame) -> DataFrame:
    """(prompt_id, sid, prompt_ordinal, i, text). resolved: sid, i, status, origin_sid, origin_i of all events."""
    order = W.partitionBy("sid").orderBy("source_ordinal")
    rows = events.withColumn("i", F.row_number().over(order) - 1).where("family = 'user_message'")
    driven = sessions.where(F.col("client_kind").isin("cli", "editor")).select("sid")
    own = rows.join(resolved.where("status = 'origin'").select("sid", "i"), ["sid", "i"]).join(driven, "sid", "left_semi")
    place = F.row_number().over(W.partitionBy("sid").orderBy("source_ordinal")) - 1
    name = F.concat(F.lit("prm_"), F.sha2(F.concat_ws("\u0000", F.col("sid").cast("string"), F.col("source_ordinal").cast("string"), "fingerprint"), 256))
    return own.select(name.alias("prompt_id"), "sid", place.alias("prompt_ordinal"), "i", "text")


def observed(prompts: DataFrame, resolved: DataFrame) -> DataFrame:
    """prompts with the number of sessions that show them, and of those that only replay them."""
    seen = resolved.where("origin_sid IS NOT NULL").groupBy(F.col("origin_sid").alias("sid"), F.col("origin_i").alias("i")).agg(F.count_distinct("sid").alias("sessions"), F.count_if(F.col("sid") != F.col("origin_sid")).alias("replays"), F.count_distinct(F.when(F.col("sid") != F.col("origin_sid"), F.col("sid"))).alias("replay_sessions"))
    return prompts.join(seen, ["sid", "i"], "left")


def snippet(text: Column) -> Column:
    return F.substring(F.translate(text, "\r\n", "  "), 1, 180)
