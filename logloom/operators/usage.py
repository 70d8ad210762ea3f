"""Token usage: session totals, attribution to event time, and breakdowns with coverage."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import vectors as V
from logloom.operators import quantiles


def session_totals(events: DataFrame) -> DataFrame:
    """(sid, semantics, observed): the last cumulative vector, else the sum of deltas; snapshots are never added."""
    if "delta" not in events.columns:
        events = events.withColumn("delta", F.lit(None).cast(V.TYPE))
    last = F.max_by("cumulative", F.when(F.col("cumulative").isNotNull(), F.col("event_ordinal")))
    by = events.groupBy("sid").agg(last.alias("last"), V.total(lambda f: F.col("delta")[f]).alias("sum"), F.count("delta").alias("deltas"))
    semantics = F.when(F.col("last").isNotNull(), "cumulative_total").when(F.col("deltas") > 0, "summed_event_deltas").otherwise("unavailable")
    return by.select("sid", semantics.alias("semantics"), F.when(F.col("last").isNotNull(), F.col("last")).when(F.col("deltas") > 0, F.col("sum")).alias("observed"))


def attributed(usage: DataFrame, events: DataFrame) -> DataFrame:
    """(sid, occurred_at, usage, status, reason): each session's accounted total dealt out to its events.

    usage: sid, semantics, accounted, baseline. Evidence that contradicts itself is not used: the whole
    total then is one row without a time, with the first reason that applies."""
    if "delta" not in events.columns:
        events = events.withColumn("delta", F.lit(None).cast(V.TYPE))
    u = usage.select("sid", "semantics", F.col("accounted").alias("target"), "baseline").where(V.known(F.col("target")))
    own = F.when(F.col("semantics") == "cumulative_total", F.col("cumulative")).when(F.col("semantics") == "summed_event_deltas", F.col("delta"))
    rows = u.join(events, "sid").select(*u.columns, "event_ordinal", "occurred_at", own.alias("v"))
    kept = rows.where("v IS NOT NULL")
    order = W.partitionBy("sid").orderBy("event_ordinal")
    cumulative = F.col("semantics") == "cumulative_total"
    kept = kept.withColumn("adjusted", F.when(cumulative, V.without_baseline(F.col("v"), F.col("baseline"), F.col("target"))))
    before_raw, before = F.lag("v").over(order), F.lag("adjusted").over(order)
    seen = F.last("occurred_at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    kept = kept.select("*", before_raw.alias("before_raw"), F.when(F.row_number().over(order) == 1, V.zero()).otherwise(before).alias("before"), seen.alias("seen"))
    step = F.when(cumulative, V.subtract(F.col("adjusted"), F.col("before"))).otherwise(V.masked(F.col("v"), F.col("target")))
    falls = F.when(cumulative & V.decreases(F.col("v"), F.col("before_raw")), 1).when(cumulative & V.decreases(F.col("adjusted"), F.col("before")), 2)
    kept = kept.select("sid", "target", "event_ordinal", "occurred_at", step.alias("step"), falls.alias("falls"), (F.col("occurred_at") < F.col("seen")).alias("back"))
    adds = V.positive(F.col("step"))
    checks = kept.groupBy("sid").agg(
        F.coalesce(F.bool_or("back"), F.lit(False)).alias("back"),
        F.min_by("falls", F.when(F.col("falls").isNotNull(), F.col("event_ordinal"))).alias("falls"),
        V.total(lambda f: F.when(adds, F.col("step")[f])).alias("sum"),
        F.count_if(adds & F.col("occurred_at").isNull()).alias("untimed"),
    )
    any_events = events.select("sid").distinct().withColumn("any", F.lit(True))
    judged = u.join(checks, "sid", "left").join(any_events, "sid", "left")
    reason = (
        F.when(F.col("any").isNull(), "token_events_unavailable")
        .when(~F.col("semantics").isin("cumulative_total", "summed_event_deltas"), "unsupported_usage_semantics")
        .when(F.col("back").isNull() & cumulative, "cumulative_snapshots_unavailable")
        .when(F.col("back").isNull(), "delta_events_unavailable")
        .when(F.col("back"), "nonmonotonic_event_timestamps")
        .when(F.col("falls") == 1, "nonmonotonic_cumulative_usage")
        .when(F.col("falls") == 2, "nonmonotonic_adjusted_usage")
        .when(~V.matches(F.col("sum"), F.col("target")), "event_total_mismatch")
    )
    judged = judged.select("sid", "target", "untimed", reason.alias("reason"))
    whole = judged.where("reason IS NOT NULL").select("sid", F.lit(None).cast("timestamp").alias("occurred_at"), F.col("target").alias("usage"), F.lit("fallback").alias("status"), "reason")
    good = judged.where("reason IS NULL").select("sid", F.when(F.col("untimed") > 0, "partial").otherwise("complete").alias("status"), F.when(F.col("untimed") > 0, "missing_event_timestamp").alias("reason"))
    dealt = kept.where(adds).join(good, "sid").select("sid", "occurred_at", F.col("step").alias("usage"), "status", "reason")
    return dealt.unionByName(whole)


def period(ts: Column, kind: str, zone: str = "UTC") -> Column:
    """The local day, or the Monday of the local week."""
    day = F.to_date(F.from_utc_timestamp(ts, zone))
    return day if kind == "day" else F.to_date(F.date_trunc("week", day))


SPREAD = {"median_tokens": (0.5, "cont"), "p90_tokens": (0.9, "disc")}


def by_dimension(scoped: DataFrame, *keys: str) -> DataFrame:
    """scoped: sessions joined to their accounted usage; keys may be empty (a summary).

    Null-preserving sum and its coverage, mean, median and nearest-rank p90 of what was observed."""
    known, observed = F.col("accounted.total_tokens"), F.col("observed.total_tokens")
    sums = scoped.groupBy(*keys).agg(F.count("*").alias("sessions"), F.sum(known).alias("tokens"), F.count(known).alias("known_sessions"), F.avg(observed).alias("mean_tokens"))
    return quantiles.same(sums, quantiles.exact(scoped, keys, observed, SPREAD), keys)


def by_period(scoped: DataFrame, contributions: DataFrame, kind: str, zone: str = "UTC") -> DataFrame:
    """Sessions by their start, tokens by event time; tokens without a time are a period of their own (null)."""
    starts = scoped.groupBy(period(F.col("started_at"), kind, zone).alias("p")).agg(F.count("*").alias("sessions"))
    parts = contributions.join(scoped.select("sid"), "sid", "left_semi")
    tokens = parts.groupBy(period(F.col("occurred_at"), kind, zone).alias("p")).agg(F.sum("usage.total_tokens").alias("tokens"), F.count_distinct("sid").alias("contributing_sessions"))
    s, t = starts.alias("s"), tokens.alias("t")
    return s.join(t, F.col("s.p").eqNullSafe(F.col("t.p")), "full").select(F.coalesce("s.p", "t.p").cast("string").alias("period"), F.coalesce("s.sessions", F.lit(0)).alias("sessions"), "t.tokens", F.coalesce("t.contributing_sessions", F.lit(0)).alias("contributing_sessions"))


def reconciliation(accounted: DataFrame) -> DataFrame:
    """One row: observed, inherited and reconciled totals, and children by state."""
    lineage = F.col("lineage")
    return accounted.agg(
        F.sum("observed.total_tokens").alias("observed_tokens"),
        F.coalesce(F.sum("baseline.total_tokens"), F.lit(0)).alias("inherited_tokens"),
        F.sum("accounted.total_tokens").alias("reconciled_tokens"),
        F.count_if(lineage.isin("inherited_prefix", "inherited_exact")).alias("reconciled_children"),
        F.count_if(lineage == "ambiguous").alias("ambiguous_children"),
        F.count_if(lineage == "cycle").alias("cyclic_children"),
        F.coalesce(F.sum(F.when(lineage == "ambiguous", F.col("observed.total_tokens"))), F.lit(0)).alias("ambiguous_tokens"),
    )


def temporal_coverage(contributions: DataFrame) -> DataFrame:
    """One row: sessions by attribution status, and the share of tokens that has a time."""
    by = contributions.groupBy("sid", "status").agg(F.sum("usage.total_tokens").alias("t"), F.sum(F.when(F.col("occurred_at").isNotNull(), F.col("usage.total_tokens"))).alias("timed"))
    return by.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_sessions") for s in ("complete", "partial", "fallback")], (F.coalesce(F.sum("timed"), F.lit(0)) / F.sum("t")).alias("attributed_fraction"))


def period_table(sessions: DataFrame, contributions: DataFrame, activity: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """(repository, sessions, tokens, calls) of a period; each on its own clock. Repositories are joined by key."""
    roots = sessions.select("sid", "repository_root")
    inside = lambda c: (F.col(c) >= F.lit(since)) & (F.col(c) < F.lit(until))
    s = sessions.where(inside("started_at")).groupBy("repository_root").agg(F.count("*").alias("sessions"))
    t = contributions.where(inside("occurred_at")).join(roots, "sid").groupBy(F.col("repository_root").alias("tr")).agg(F.sum("usage.total_tokens").alias("tokens"))
    c = activity.where(inside("occurred_at")).join(roots, "sid").groupBy(F.col("repository_root").alias("cr")).agg(F.count("*").alias("calls"))
    rows = s.join(t, F.col("repository_root").eqNullSafe(F.col("tr")), "left").join(c, F.col("repository_root").eqNullSafe(F.col("cr")), "left")
    return rows.select(F.col("repository_root").alias("repository"), "sessions", "tokens", F.coalesce("calls", F.lit(0)).alias("calls"))


def comparison(sessions: DataFrame, contributions: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """One row: a period against the equally long one before."""
    before = since - (until - since)

    def one(a: datetime, z: datetime, tail: str) -> DataFrame:
        s = sessions.where((F.col("started_at") >= F.lit(a)) & (F.col("started_at") < F.lit(z))).agg(F.count("*").alias("sessions" + tail))
        t = contributions.where((F.col("occurred_at") >= F.lit(a)) & (F.col("occurred_at") < F.lit(z))).agg(F.sum("usage.total_tokens").alias("tokens" + tail))
        return s.crossJoin(t)  # one row each

    both = one(since, until, "").crossJoin(one(before, since, "_before"))
    return both.withColumn("tokens_change", F.when(F.col("tokens_before") > 0, (F.col("tokens") - F.col("tokens_before")) / F.col("tokens_before")))


def zone_name(where: tzinfo) -> str:
    return getattr(where, "key", None) or "UTC"


def windowed(scoped: DataFrame, contributions: DataFrame, since: datetime | None = None, until: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): the contributions in the window, and the sessions that have one or began in it, with what they used in it.

    Without bounds everything stays, contributions without a time too; with a bound those are left out."""
    parts = contributions.join(scoped.select("sid"), "sid", "left_semi")
    bounded = since is not None or until is not None
    inside = lambda c: (F.lit(True) if since is None else F.col(c) >= F.lit(since)) & (F.lit(True) if until is None else F.col(c) < F.lit(until))
    if bounded:
        parts = parts.where(F.col("occurred_at").isNotNull() & inside("occurred_at"))
    used = parts.groupBy("sid").agg(V.total(lambda f: F.col("usage")[f]).alias("used"), F.count("*").alias("parts"))
    rows = scoped.join(used, "sid", "left")
    if bounded:
        rows = rows.where(F.col("parts").isNotNull() | F.coalesce(inside("started_at"), F.lit(False)))
    return rows, parts


def scope(rows: DataFrame, parts: DataFrame, where: tzinfo = UTC, since: datetime | None = None, until: datetime | None = None, now: datetime | None = None) -> DataFrame:
    """One row: first and last local day of the scope, and how many those are."""
    days = rows.select(period(F.col("started_at"), "day", zone_name(where)).alias("d")).union(parts.select(period(F.col("occurred_at"), "day", zone_name(where)))).agg(F.min("d").alias("a"), F.max("d").alias("z"))
    a = F.lit(since.astimezone(where).date()) if since else F.col("a")
    if until is not None:
        z = F.lit((until - timedelta(microseconds=1)).astimezone(where).date())
    else:
        z = F.lit((now or datetime.now(UTC)).astimezone(where).date()) if since else F.col("z")
    return days.select(a.alias("first_day"), z.alias("last_day")).withColumn("days", F.when(F.col("last_day") >= F.col("first_day"), F.datediff("last_day", "first_day") + 1))


def window_metrics(rows: DataFrame, days: DataFrame, *keys: str) -> DataFrame:
    """Sessions, what they used in the window with how many of them tell it, what they used in all, and sessions a day, by keys."""
    total = F.col("observed.total_tokens")
    by = rows.groupBy(*keys).agg(
        F.count("*").alias("sessions"),
        *[F.sum(F.col("used")[f]).alias(f) for f in V.FIELDS if f != "cache_write_input_tokens"],
        F.count("used.total_tokens").alias("known_sessions"),
        F.sum(total).alias("observed_tokens"),
        F.avg(total).alias("mean_tokens"),
    )
    by = quantiles.same(by, quantiles.exact(rows, keys, total, SPREAD), keys)
    return by.crossJoin(days.select("days")).withColumn("sessions_per_day", F.when(F.col("days") > 0, F.col("sessions") / F.col("days"))).drop("days")  # one row


def ranked(groups: DataFrame, label: Column, *keys: str, top: int | None = None) -> DataFrame:
    """Groups in the order of reports: known totals first, the greatest first, then by sessions, label and key."""
    if top is not None and top < 1:
        raise ValueError("top must be at least 1")
    rows = groups.orderBy(F.desc_nulls_last("total_tokens"), F.desc("sessions"), F.lower(label), *keys)
    return rows.limit(top) if top else rows


def window_periods(rows: DataFrame, parts: DataFrame, days: DataFrame, kind: str, where: tzinfo = UTC) -> DataFrame:
    """By local day or week: sessions by their start, tokens by event time, sessions a day over the days of the period that are in scope.

    Tokens without a time (of windows without bounds) are a period of their own, the last."""
    zone = zone_name(where)
    total = F.col("observed.total_tokens")
    starts = rows.where("started_at IS NOT NULL").groupBy(period(F.col("started_at"), kind, zone).alias("p")).agg(F.count("*").alias("sessions"), F.avg(total).alias("mean_tokens"), F.median(total).alias("median_tokens"))
    tokens = parts.groupBy(period(F.col("occurred_at"), kind, zone).alias("p")).agg(F.sum("usage.total_tokens").alias("tokens"), F.count_distinct("sid").alias("contributing_sessions"))
    s, t = starts.alias("s"), tokens.alias("t")
    both = s.join(t, F.col("s.p").eqNullSafe(F.col("t.p")), "full").select(F.coalesce("s.p", "t.p").alias("p"), F.coalesce("s.sessions", F.lit(0)).alias("sessions"), "t.tokens", F.coalesce("t.contributing_sessions", F.lit(0)).alias("contributing_sessions"), "s.mean_tokens", "s.median_tokens")
    both = both.crossJoin(days.select("first_day", "last_day"))  # one row
    first, last = F.greatest("p", "first_day"), F.least(F.date_add("p", 6 if kind == "week" else 0), F.col("last_day"))
    n = F.when(F.col("p").isNotNull() & (last >= first), F.datediff(last, first) + 1)
    rows = both.withColumn("sessions_per_day", F.when(n > 0, F.col("sessions") / n)).drop("first_day", "last_day")
    return rows.orderBy(F.asc_nulls_last("p")).withColumn("p", F.col("p").cast("string")).withColumnRenamed("p", "period")


def child_states(accounted: DataFrame, edges: DataFrame, session_ids: DataFrame) -> DataFrame:
    """One row: totals observed, inherited and reconciled, threads by state, and the share of children with tokens that is accounted for."""
    s, total = F.col("lineage"), F.col("observed.total_tokens")
    sure = s.isin("inherited_prefix", "inherited_exact")
    known = F.count_if((s != "root") & total.isNotNull())
    ids = session_ids.select("sid").distinct()
    orphans = edges.join(ids.select(F.col("sid").alias("parent"), F.lit(1).alias("p")), "parent", "left").join(ids.select(F.col("sid").alias("child"), F.lit(1).alias("c")), "child", "left").agg(F.count_if(F.col("p").isNull() | F.col("c").isNull()).alias("orphan_edges"))
    row = accounted.agg(
        F.sum(total).alias("observed_tokens"),
        F.coalesce(F.sum(F.when(sure, F.col("baseline.total_tokens"))), F.lit(0)).alias("inherited_tokens"),
        F.sum("accounted.total_tokens").alias("reconciled_tokens"),
        F.count_if(s == "root").alias("root_threads"),
        F.count_if(s != "root").alias("child_threads"),
        F.count_if(sure).alias("reconciled_children"),
        *[F.count_if(s == k).alias(f"{k}_children") for k in ("independent", "ambiguous", "unavailable", "cycle")],
        F.coalesce(F.sum(F.when(s.isin("ambiguous", "cycle"), total)), F.lit(0)).alias("ambiguous_tokens"),
        F.when(known > 0, F.count_if((sure | (s == "independent")) & total.isNotNull()) / known).alias("child_coverage"),
    )
    return row.crossJoin(orphans)  # one row each


def attribution_coverage(contributions: DataFrame, accounted: DataFrame) -> DataFrame:
    """One row: sessions by attribution status (unavailable: no contribution), tokens with and without a time, and reasons with their sessions."""
    t = F.col("usage.total_tokens")
    by = contributions.groupBy("sid").agg(F.first("status").alias("status"), F.first("reason").alias("reason"), F.sum(F.when(F.col("occurred_at").isNotNull(), t)).alias("timed"), F.sum(F.when(F.col("occurred_at").isNull(), t)).alias("untimed"))
    rows = accounted.select("sid").join(by, "sid", "left")
    counts = rows.agg(*[F.count_if(F.coalesce("status", F.lit("unavailable")) == s).alias(f"{s}_sessions") for s in ("complete", "partial", "fallback", "unavailable")], F.coalesce(F.sum("timed"), F.lit(0)).alias("attributed_tokens"), F.coalesce(F.sum("untimed"), F.lit(0)).alias("unattributed_tokens"))
    reasons = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))  # a row per reason
    total = F.col("attributed_tokens") + F.col("unattributed_tokens")
    return counts.crossJoin(reasons).withColumn("attributed_fraction", F.when(total > 0, F.col("attributed_tokens") / total))
