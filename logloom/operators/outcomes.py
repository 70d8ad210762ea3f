"""Outcomes of sessions from ordered evidence: (sid, sequence, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("validation_pass", "validation_fail", "edit", "task_complete", "abort", "error", "high_commit")


def evidence(activity: DataFrame, lifecycle: DataFrame, commits: DataFrame) -> DataFrame:
    """activity: sid, source_ordinal, occurred_at, command_category, result_status; lifecycle: sid, source_ordinal, kind;
    commits: sid, committed_at. A commit stands right after the latest evidence that is not later than it."""
    c, r = F.col("command_category"), F.col("result_status")
    kind = F.when((c == "testing") & (r == "success"), "validation_pass").when((c == "testing") & (r == "failure"), "validation_fail").when(c == "editing_patching", "edit")
    acts = activity.select("sid", (F.col("source_ordinal") * 10).alias("sequence"), kind.alias("kind"), "occurred_at").where("kind IS NOT NULL")
    life = lifecycle.select("sid", (F.col("source_ordinal") * 10 + 5).alias("sequence"), "kind", F.lit(None).cast("timestamp").alias("occurred_at"))
    known = acts.unionByName(life)
    # as-of: all evidence and the commits in one order of time, the greatest sequence so far carried on
    marks = known.where("occurred_at IS NOT NULL").select("sid", F.col("occurred_at").alias("at"), F.lit(0).alias("late"), "sequence").unionByName(commits.select("sid", F.col("committed_at").alias("at"), F.lit(1).alias("late"), F.lit(None).cast("long").alias("sequence")))
    so_far = F.max("sequence").over(W.partitionBy("sid").orderBy("at", "late").rowsBetween(W.unboundedPreceding, 0))
    placed = marks.withColumn("s", so_far).where("late = 1").select("sid", (F.coalesce("s", F.lit(0)) + 1).alias("sequence"), F.lit("high_commit").alias("kind"))
    return known.drop("occurred_at").unionByName(placed)


def classified(evidence: DataFrame) -> DataFrame:
    """(sid, outcome, confidence, lifecycle). Later evidence overrules earlier; rules in order."""
    order = W.partitionBy("sid").orderBy("sequence", "kind")
    placed = evidence.withColumn("at", F.row_number().over(order))
    last = placed.groupBy("sid").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("at"))), F.lit(-1)).alias(k) for k in KINDS])
    v = {k: F.col(k) for k in KINDS}
    good = F.greatest(v["validation_pass"], v["high_commit"])
    aborted = v["abort"] > v["task_complete"]
    rule = (
        F.when(aborted, 0)
        .when((v["validation_fail"] >= 0) & (v["validation_pass"] <= v["validation_fail"]), 1)
        .when((v["error"] >= 0) & (good <= v["error"]), 2)
        .when(v["validation_fail"] >= 0, 3)
        .when(good >= 0, 4)
        .when(v["edit"] >= 0, 5)
        .otherwise(6)
    )

    def pick(*values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)

    return last.withColumn("rule", rule).select(
        "sid",
        pick("abandoned", "failed", "failed", "success_with_warnings", "success", "partial", "unknown").alias("outcome"),
        pick("high", "high", "medium", "medium", "medium", "low", "low").alias("confidence"),
        F.when(aborted, "aborted").when(v["task_complete"] >= 0, "turn_completed").otherwise("unknown").alias("lifecycle"),
    )


def strong(outcome: Column, confidence: Column) -> Column:
    return (outcome != "unknown") & confidence.isin("high", "medium")


def report(outcomes: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return outcomes.groupBy("outcome", "confidence").agg(F.count("*").alias("sessions"), F.count_if(strong(o, F.col("confidence"))).alias("strong"))
