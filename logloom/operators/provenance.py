"""Which events of a child session replay its parent's: exact ordered evidence only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoints import checkpointed
from logloom.operators.lineage import ancestry, in_cycles, prefix_runs, single_parent

INHERITED = ("inherited_prefix", "inherited_exact")


def event_verdicts(events: DataFrame, edges: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(parent, child, i, family, source_ordinal, status, evidence, parent_ordinal) of each event of each child.

    events: sid, source_ordinal, family, fingerprint, and stable_id (null if unknown). Rules in order: a
    run of two at least over all families, one within a family, a single parent event of the same stable
    id; then what the parent has under other ids, under no comparable id, or not at all."""
    if "stable_id" not in events.columns:
        events = events.withColumn("stable_id", F.lit(None).cast("string"))
    order = W.partitionBy("sid").orderBy("source_ordinal")
    own = W.partitionBy("sid", "family").orderBy("source_ordinal")
    rows = events.select("sid", "source_ordinal", "family", "fingerprint", "stable_id", (F.row_number().over(order) - 1).alias("i"), (F.row_number().over(own) - 1).alias("k"), F.concat_ws("|", "family", "fingerprint").alias("key"))
    e = single_parent(edges)
    e = in_cycles(e, ancestry(edges) if above is None else above)
    c = e.join(rows, e.child == rows.sid).drop("sid")
    p = e.join(rows, e.parent == rows.sid).drop("sid").where("cyclic IS NULL")
    has_parent = p.select("parent", "child", F.lit(True).alias("seen")).distinct()
    usable = c.where("cyclic IS NULL")
    edge = ["parent", "child"]
    whole = prefix_runs(p.select(*edge, "i", "key"), usable.select(*edge, "i", "key"), edge).where("matched >= 2").select(*edge, F.col("start").alias("w_start"), F.col("matched").alias("w_len"))
    part = prefix_runs(p.select(*edge, "family", F.col("k").alias("i"), "key"), usable.select(*edge, "family", F.col("k").alias("i"), "key"), [*edge, "family"]).where("matched >= 2")
    part = part.select(*edge, "family", F.col("start").alias("f_start"), F.col("matched").alias("f_len"))
    by_id = p.where("stable_id IS NOT NULL").groupBy(*edge, "key", "stable_id").agg(F.count("*").alias("id_n"), F.min("i").alias("id_at"))
    prints = p.groupBy(*edge, "key").agg(F.count_if(F.col("stable_id").isNull()).alias("anonymous"))
    k_at = p.select(*edge, "family", F.col("k").alias("pk"), F.col("i").alias("pk_i"))
    j = c.join(has_parent, edge, "left").join(whole, edge, "left").join(part, [*edge, "family"], "left").join(by_id, [*edge, "key", "stable_id"], "left").join(prints, [*edge, "key"], "left")
    in_whole, in_part = F.coalesce(F.col("i") < F.col("w_len"), F.lit(False)), F.coalesce(F.col("k") < F.col("f_len"), F.lit(False))
    j = j.withColumn("pk", F.when(in_part, F.col("f_start") + F.col("k"))).join(k_at, [*edge, "family", "pk"], "left")
    shared = F.col("anonymous").isNotNull()
    rule = (
        F.when(F.col("cyclic"), 0)
        .when(F.col("seen").isNull(), 1)
        .when(in_whole, 2)
        .when(in_part, 3)
        .when(F.col("id_n") == 1, 4)
        .when(shared & F.col("stable_id").isNotNull() & (F.col("anonymous") == 0) & F.col("id_n").isNull(), 5)
        .when(shared, 6)
        .otherwise(7)
    )
    at = F.when(rule == 2, F.col("w_start") + F.col("i")).when(rule == 3, F.col("pk_i")).when(rule == 4, F.col("id_at"))

    def pick(*v: str):
        return F.element_at(F.array(*map(F.lit, v)), F.col("rule") + 1)

    return j.select(*edge, "i", "family", "source_ordinal", rule.alias("rule"), at.alias("parent_index")).select(
        *edge,
        "i",
        "family",
        "source_ordinal",
        pick("ambiguous", "unknown", "inherited_prefix", "inherited_prefix", "inherited_exact", "origin", "ambiguous", "origin").alias("status"),
        pick("cyclic_spawn_graph", "parent_event_data_unavailable", "exact_ordered_cross_family_prefix", "exact_ordered_family_prefix", "exact_fingerprint_and_stable_source_id", "distinct_stable_source_id", "unordered_or_single_fingerprint_overlap", "not_observed_in_explicit_parent").alias("evidence"),
        "parent_index",
    )


def replay_summary(verdicts: DataFrame) -> DataFrame:
    """Counts per edge and family, with the status that prevails."""
    s = F.col("status")
    by = verdicts.groupBy("parent", "child", "family").agg(
        F.count("*").alias("observed"),
        F.count_if(s == "origin").alias("originated"),
        F.count_if(s.isin(*INHERITED)).alias("inherited"),
        F.count_if(s == "ambiguous").alias("ambiguous"),
        F.count_if(s == "unknown").alias("unknown"),
    )
    return by.withColumn("status", F.when(F.col("inherited") > 0, "inherited_prefix").when(F.col("ambiguous") > 0, "ambiguous").when(F.col("unknown") > 0, "unknown").otherwise("origin"))


def origins(events: DataFrame, verdicts: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, i, status, origin_sid, origin_i): inherited events followed up to where they began.

    Pointers double in reach each round. An event whose trail ends in an ambiguous or unknown one is ambiguous.
    Events of a session without a parent are its own; those of a child without a verdict (of several
    parents, that is) are unknown."""
    order = W.partitionBy("sid").orderBy("source_ordinal")
    every = events.select("sid", (F.row_number().over(order) - 1).alias("i"))
    v = verdicts.select(F.col("child").alias("sid"), "i", "status", F.when(F.col("status").isin(*INHERITED), F.struct(F.col("parent").alias("sid"), F.col("parent_index").alias("i"))).alias("up"))
    spawned = edges.select(F.col("child").alias("sid"), F.lit("unknown").alias("none")).distinct()
    every = every.join(spawned, "sid", "left")
    now = checkpointed(every.join(v, ["sid", "i"], "left").select("sid", "i", F.coalesce("status", "none", F.lit("origin")).alias("status"), "up", F.struct("sid", "i").alias("top")))
    own = now.select(F.struct("sid", "i").alias("at"), F.col("status").alias("top_status"))
    trail = now.select("sid", "i", "status", "up", F.coalesce("up", "top").alias("top"))
    while True:
        trail = checkpointed(trail)
        if trail.where("up IS NOT NULL").isEmpty():
            break
        ahead = trail.select(F.struct("sid", "i").alias("up"), F.col("up").alias("next"), F.col("top").alias("far"))
        trail = trail.join(ahead, "up", "left").select("sid", "i", "status", F.col("next").alias("up"), F.coalesce("far", "top").alias("top"))
    ends = trail.join(own, trail.top == own["at"], "left")
    weak = F.col("status").isin(*INHERITED) & F.coalesce(F.col("top_status").isin("ambiguous", "unknown"), F.lit(True))
    kept = F.col("status").isin(*INHERITED, "origin") & ~weak
    return ends.select("sid", "i", F.when(weak, "ambiguous").otherwise(F.col("status")).alias("status"), F.when(kept, F.col("top.sid")).alias("origin_sid"), F.when(kept, F.col("top.i")).alias("origin_i"))


def mirrored(events: DataFrame) -> DataFrame:
    """(sid, source_ordinal) of user records that the next record repeats in the other notation.

    events: sid, source_ordinal, family, fingerprint, payload_type."""
    w = W.partitionBy("sid").orderBy("source_ordinal")
    rows = events.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("source_ordinal", "family", "fingerprint", "payload_type")])
    return rows.where("family = 'user_message' AND n_family = family AND n_fingerprint = fingerprint AND payload_type = 'message' AND n_payload_type = 'user_message' AND n_source_ordinal = source_ordinal + 1").select("sid", "source_ordinal")


def by_family(verdicts: DataFrame) -> DataFrame:
    s = F.col("status")
    return verdicts.groupBy("family").agg(F.count("*").alias("observed"), F.count_if(s == "origin").alias("originated"), F.count_if(s.isin(*INHERITED)).alias("inherited"), F.count_if(s == "ambiguous").alias("ambiguous"), F.count_if(s == "unknown").alias("unknown"), F.count_distinct(F.when(s.isin(*INHERITED), F.col("child"))).alias("replaying_children"))
