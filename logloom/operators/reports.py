"""Tables of reports: histograms, comparisons, notes on sessions, and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import quantiles


def histogram(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys and out: ``value=count`` in the order of the values, as one text."""
    by = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), "n"))), lambda x: F.concat_ws("=", x["v"], x["n"]))
    return by.groupBy(*keys).agg(F.array_join(pairs, ",").alias(out))


def joined(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first table with the others' columns, by null-safe keys."""
    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
        same = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys])
        return a.join(b, same, "left").drop(*[f"__{k}" for k in keys])

    return reduce(one, tables)


def task_metrics(facts: DataFrame, *keys: str) -> DataFrame:
    """facts: a row per session with action, domain, tokens (accounted), observed, commands, commits, prompts, feature_prompts, outcome, confidence, and the keys."""
    total = facts.groupBy(*keys).agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("action") == "unknown").alias("unknown_tasks"),
        F.sum("tokens").alias("tokens"),
        F.count("tokens").alias("known_sessions"),
        F.sum("commands").alias("commands"),
        F.sum("commits").alias("commits"),
        F.sum("prompts").alias("prompts"),
        F.count_if(F.col("feature_prompts") > 0).alias("sessions_with_features"),
        F.sum("feature_prompts").alias("prompts_with_features"),
    )
    total = quantiles.same(total, quantiles.exact(facts, keys, F.col("observed"), {"observed_median": (0.5, "cont"), "observed_p90": (0.9, "cont")}), keys)
    if not keys:
        return total
    return joined([total, histogram(facts, list(keys), "outcome", "outcomes"), histogram(facts, list(keys), "confidence", "confidences")], list(keys)).orderBy(F.desc("sessions"), *keys)


def task_evidence(facts: DataFrame, *keys: str) -> DataFrame:
    """What sessions' tasks rest on: prompts; activity or commits alone; the repository's name alone (fallback); nothing."""
    prompt, act = F.col("prompts") > 0, (F.col("activity") > 0) | (F.col("commits") > 0)
    basis = F.when(prompt, "prompt_backed").when(act, "originated_activity_only").when(F.array_contains("evidence", "fallback_repository_name"), "fallback_only").otherwise("no_origin_evidence")
    none = (F.col("action") == "unknown") & (F.col("domain") == "unknown")
    some = (F.col("action") == "unknown") | (F.col("domain") == "unknown")
    rows = facts.withColumn("basis", basis)
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("basis") == b).alias(b) for b in ("prompt_backed", "originated_activity_only", "fallback_only", "no_origin_evidence")], F.count_if(F.col("client_kind") == "subagent").alias("subagent_sessions"), F.count_if(~prompt & none).alias("both_unknown_without_prompt"), F.count_if(prompt & some).alias("prompt_backed_unknown"))


def feature_outcomes(facts: DataFrame, features: list[str], least: int = 5) -> DataFrame:
    """(feature, eligible, with_n, without_n, with_outcomes, without_outcomes) over sessions with features; outcomes are told only where both sides have enough."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("present")) for f in features]))
    rows = facts.where("feature_prompts > 0").select("outcome", pairs.alias("p")).select("outcome", "p.*")
    n = rows.groupBy("feature").agg(F.count_if("present").alias("with_n"), F.count_if(~F.col("present")).alias("without_n"))
    on, off = histogram(rows.where("present"), ["feature"], "outcome", "on"), histogram(rows.where("NOT present"), ["feature"], "outcome", "off")
    ok = (F.col("with_n") >= least) & (F.col("without_n") >= least)
    return n.join(on, "feature", "left").join(off, "feature", "left").select("feature", ok.alias("eligible"), "with_n", "without_n", F.when(ok, F.col("on")).alias("with_outcomes"), F.when(ok, F.col("off")).alias("without_outcomes"))


def outcome_fractions(rows: DataFrame) -> DataFrame:
    """(outcome, sessions, fraction, strong, strong_fraction): fractions of the classifiable and of the strongly evidenced; none for unknown.

    rows: outcome, confidence of every session."""
    sure = (F.col("outcome") != "unknown") & F.col("confidence").isin("high", "medium")
    by = rows.groupBy("outcome").agg(F.count("*").alias("sessions"), F.count_if(sure).alias("strong"))
    known = by.agg(F.sum(F.when(F.col("outcome") != "unknown", F.col("sessions"))).alias("all"), F.sum("strong").alias("sure"))
    told = F.col("outcome") != "unknown"
    return by.crossJoin(known).select("outcome", "sessions", F.when(told & (F.col("all") > 0), F.col("sessions") / F.col("all")).alias("fraction"), "strong", F.when(told & (F.col("sure") > 0), F.col("strong") / F.col("sure")).alias("strong_fraction"))  # one row


def changes(now: DataFrame, before: DataFrame, metrics: list[str], coverage: str, drift: float = 0.1) -> DataFrame:
    """(metric, current, previous, change, percentage_change, comparable): two one-row tables; no percentages where the coverage moved by more than drift or is known on one side only."""
    a, b = F.col(f"a.{coverage}"), F.col(f"b.{coverage}")
    same = F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(F.abs(a - b) <= drift, F.lit(False)))
    both = now.alias("a").crossJoin(before.alias("b"))  # one row each
    rows = both.select(same.alias("comparable"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("long").alias("current"), F.col(f"b.{m}").cast("long").alias("previous")) for m in metrics])).alias("m")).select("m.*", "comparable")
    change = F.col("current") - F.col("previous")
    return rows.select("metric", "current", "previous", change.alias("change"), F.when(F.col("comparable") & (F.col("previous") != 0), change / F.col("previous")).alias("percentage_change"), "comparable")


def notes(rows: DataFrame) -> DataFrame:
    """(reason, session_id, ...): the session of most tokens and the longest one (of equals the greater id), the same one once; ids are cut to 12 characters.

    rows: id (text), total_tokens, seconds, and what else a note tells."""
    rest = [c for c in rows.columns if c != "id"]
    most = F.max_by(F.struct("id", *rest), F.struct("total_tokens", "id"))
    long = F.max_by(F.struct("id", *rest), F.struct("seconds", "id"))
    first = rows.where("total_tokens IS NOT NULL").agg(most.alias("s")).select(F.lit("highest_observed_rollout_total").alias("reason"), F.lit(0).alias("k"), "s")
    second = rows.where("seconds IS NOT NULL").agg(long.alias("s")).select(F.lit("longest_session").alias("reason"), F.lit(1).alias("k"), "s")
    both = first.unionByName(second).where("s IS NOT NULL")  # two rows at most
    kept = both.groupBy("s.id").agg(F.min_by(F.struct("reason", "s"), "k").alias("x"))
    return kept.select("x.reason", F.substring("x.s.id", 1, 12).alias("session_id"), *[F.col(f"x.s.{c}").alias(c) for c in rest])
