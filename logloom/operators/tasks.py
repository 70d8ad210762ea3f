"""Task intent of sessions from their prompts, with activity as the fallback, and reports by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import prompts as P
from logloom.operators import quantiles


def classified(prompts: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """(sid, action, domain, facets, confidence, evidence).

    prompts: sid, prompt_ordinal, text. The first prompt counts three, others two, each rule three hits
    at most; the greatest sum wins, the first rule of equals. activity: sid, command_category (originated),
    used where no rule has a hit."""
    clean = prompts.select("sid", "prompt_ordinal", P.lines_without(F.col("text"), P.NEGATED).alias("t"))
    weight = F.when(F.col("prompt_ordinal") == 0, 3).otherwise(2)
    both = P.ACTIONS + P.DOMAINS
    each = clean.select("sid", P.scores(F.col("t"), weight, both).alias("s"), F.array(*[F.col("t").rlike(P.unicode(p)) for _, p in P.FACETS]).alias("f"))
    n = len(P.ACTIONS)
    sums = each.groupBy("sid").agg(F.array(*[F.sum(F.get("s", i)) for i in range(len(both))]).alias("s"), F.array(*[F.bool_or(F.get("f", i)) for i in range(len(P.FACETS))]).alias("f"))
    if activity is not None:
        kinds = activity.groupBy("sid").agg(F.collect_set("command_category").alias("kinds"))
        sums = sums.join(kinds, "sid", "full")
    else:
        sums = sums.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array(*[F.lit(0)] * len(both)).cast("array<bigint>")
    s = F.coalesce(F.col("s"), none)
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    by_act = F.when(has("testing"), "testing").when(has("editing_patching"), "implementation").when(has("git_mutation"), "git_or_release").otherwise("unknown")
    by_dom = F.when(has("scientific_computation"), "scientific_computing").when(has("testing") | has("editing_patching"), "software_engineering").when(has("git_mutation"), "git_release").otherwise("unknown")
    actions, domains = F.slice(s, 1, n), F.slice(s, n + 1, len(P.DOMAINS))
    action, domain = F.coalesce(P.best(actions, P.ACTIONS), by_act), F.coalesce(P.best(domains, P.DOMAINS), by_dom)
    top = F.array_max(actions)
    facets = F.array_compact(F.array(*[F.when(F.get("f", i), F.lit(name)) for i, (name, _) in enumerate(P.FACETS)]))
    evidence = F.array_compact(F.array(*[F.when(F.get(s, i) > 0, F.lit(("action_" if i < n else "domain_") + name)) for i, (name, _) in enumerate(both)]))
    return sums.select(
        "sid",
        action.alias("action"),
        domain.alias("domain"),
        facets.alias("facets"),
        F.when(top >= 3, "high").when((action != "unknown") | (domain != "unknown"), "medium").otherwise("low").alias("confidence"),
        F.when(F.size(evidence) > 0, evidence).otherwise(F.array(F.lit("insufficient_origin_intent"))).alias("evidence"),
    )


def report(facts: DataFrame, *keys: str) -> DataFrame:
    """facts: sid, tokens, outcome, and the keys; p90 here interpolates."""
    sums = facts.groupBy(*keys).agg(
        F.count("*").alias("sessions"),
        F.sum("tokens").alias("tokens"),
        F.count("tokens").alias("known_sessions"),
        F.count_if(F.col("outcome").startswith("success")).alias("successes"),
    )
    return quantiles.same(sums, quantiles.exact(facts, keys, F.col("tokens"), {"median_tokens": (0.5, "cont"), "p90_tokens": (0.9, "cont")}), keys)
