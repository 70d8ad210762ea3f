"""Commits linked to sessions, by tier of evidence.

HIGH: a successful commit action shows the hash, or a beginning that one commit of the repository has; it is
not looked at further. MEDIUM: the one commit in the action's time, made after the commit that the session
started from, by a successful action, while no other session of the repository is open. LOW: the nearest of
the others in the action's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoints import Scratch, scratch, written
from logloom.operators.history import descends

GRACE = 600  # seconds after a session's end
OPEN = 1800  # seconds that a session without an end is taken to go on after an action
BLOCK_BITS = 12  # 4,096 commits are a block
TIERS = ("low", "medium", "high")


def by_hash(actions: DataFrame, commits: DataFrame) -> DataFrame:
    """(sid, event_id, commit_hash): successful actions with a shown_hash of seven characters or more that one commit of the repository begins with."""
    a = actions.where("result_status = 'success' AND length(shown_hash) >= 7").withColumn("short", F.substring("shown_hash", 1, 7))
    c = commits.select("repository_root", "commit_hash", F.substring("commit_hash", 1, 7).alias("short"))
    found = a.join(c, ["repository_root", "short"]).where(F.col("commit_hash").startswith(F.col("shown_hash")))
    return found.groupBy("sid", "event_id").agg(F.count("*").alias("n"), F.min("commit_hash").alias("commit_hash")).where("n = 1").drop("n")


def spanned(actions: DataFrame) -> DataFrame:
    """Actions with latest, the last time that a candidate of theirs may have."""
    until = F.coalesce(F.col("until"), F.col("occurred_at") + F.expr(f"INTERVAL {OPEN} SECONDS")) + F.expr(f"INTERVAL {GRACE} SECONDS")
    return actions.where("repository_root IS NOT NULL").withColumn("latest", until).where("latest >= occurred_at")


def started(commit: Column, start: Column) -> Column:
    """Whether it is the commit that the session started from."""
    return F.coalesce((F.length(start) >= 7) & commit.startswith(F.lower(start)), F.lit(False))


def candidates(actions: DataFrame, commits: DataFrame) -> DataFrame:
    """(sid, event_id, repository_root, commit_hash, committed_at, result_status, occurred_at, start_hash, n) with action time <= commit time <= session end + grace; not the commit that the session started from.

    actions: sid, event_id, repository_root, occurred_at, until, result_status, start_hash (null if unknown). An action's
    commits are a run of places in its repository's order, so it meets blocks of commits, however long its time is, and
    n is known before any pair is made: pairs are never moved."""
    with scratch(commits.sparkSession) as tables:
        a, c = counted(actions, commits, tables)
        a, c = written(a), written(c)
    a = a.withColumn("own_start", F.when(F.col("own") > 0, F.lower("start_hash"))).withColumn("block", F.explode(F.sequence(F.shiftright("first", BLOCK_BITS), F.shiftright(F.col("end") - 1, BLOCK_BITS))))
    near = a.join(c.withColumn("block", F.shiftright("pos", BLOCK_BITS)), ["repository_root", "block"]).where("pos >= first AND pos < end AND NOT coalesce(startswith(commit_hash, own_start), false)")
    return near.select("sid", "event_id", "repository_root", "commit_hash", "committed_at", "result_status", "occurred_at", "start_hash", "n")


def numbered(actions: DataFrame, commits: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(actions with first and end, commits with pos): commits stand in the order of time and hash of their repository, and those from first, before end, lie in the action's time.

    One order over commits and the times that are asked about; counts run within a day of a repository, and over the
    counts of its days, so no pair of an action and a commit is made."""
    c = commits.where("repository_root IS NOT NULL AND committed_at IS NOT NULL").select("repository_root", F.col("committed_at").alias("at"), F.lit(1).alias("turn"), "commit_hash")
    times = lambda name, turn: actions.select("repository_root", F.col(name).alias("at"), F.lit(turn).alias("turn"), F.lit(None).cast("string").alias("commit_hash")).distinct()
    line = c.unionByName(times("occurred_at", 0)).unionByName(times("latest", 2)).withColumn("day", F.to_date("at"))
    one = (F.col("turn") == 1).cast("long")
    days = line.groupBy("repository_root", "day").agg(F.sum(one).alias("commits"))
    earlier = F.coalesce(F.sum("commits").over(W.partitionBy("repository_root").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(one).over(W.partitionBy("repository_root", "day").orderBy("at", "turn", "commit_hash").rowsBetween(W.unboundedPreceding, 0))
    placed = line.withColumn("inside", inside).join(days.select("repository_root", "day", earlier.alias("earlier")), ["repository_root", "day"])
    placed = tables.put("placed", placed.select("repository_root", "at", "turn", "commit_hash", (F.col("inside") + F.col("earlier")).alias("upto")))
    at = lambda turn, time, name: placed.where(F.col("turn") == turn).select("repository_root", F.col("at").alias(time), F.col("upto").alias(name))
    known = actions.join(at(0, "occurred_at", "first"), ["repository_root", "occurred_at"]).join(at(2, "latest", "end"), ["repository_root", "latest"])
    return known, placed.where("turn = 1").select("repository_root", (F.col("upto") - 1).alias("pos"), "commit_hash", F.col("at").alias("committed_at"))


def counted(actions: DataFrame, commits: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(actions that have candidates, commits), as numbered gives them; with own, how many of the commits in its time an action's session started from, n_own, how many are left, and n, those of the event."""
    a, c = numbered(spanned(actions), commits, tables)
    a = tables.put("numbered", a.withColumn("row", F.monotonically_increasing_id()))
    begun = a.where("length(start_hash) >= 7").select("row", "repository_root", "first", "end", F.lower("start_hash").alias("start"), F.lower(F.substring("start_hash", 1, 7)).alias("short"))
    own = begun.join(c.withColumn("short", F.substring("commit_hash", 1, 7)), ["repository_root", "short"]).where("startswith(commit_hash, start) AND pos >= first AND pos < end")
    a = a.join(own.groupBy("row").agg(F.count("*").alias("own")), "row", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("n_own", F.col("end") - F.col("first") - F.col("own"))
    a = tables.put("counted", a.where("n_own > 0").withColumn("n", F.sum("n_own").over(W.partitionBy("event_id"))))
    tables.drop("numbered")
    return a, c


def nearest(actions: DataFrame, commits: DataFrame, k: int = 5, tables: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, found): for each action with candidates sid, event_id and n_own, how many it has; and the k candidates of an event that are nearest in time, as candidates gives them, with their place.

    Candidates come no earlier than their action, so the nearest are those that follow it, and only these are joined.
    start_hash is left null where it can't matter: where an event has several candidates."""
    tables = tables or Scratch(commits.sparkSession)
    a, c = counted(actions, commits, tables)
    next_ = F.sequence(F.col("first"), F.least("end", F.col("first") + k + F.col("own")) - 1)
    slim = a.withColumn("start_hash", F.when((F.col("n") == 1) | (F.col("own") > 0), F.col("start_hash"))).withColumn("pos", F.explode(next_))
    found = slim.join(c, ["repository_root", "pos"]).where(~started(F.col("commit_hash"), F.col("start_hash")))
    order = W.partitionBy("event_id").orderBy(F.abs(F.unix_micros("committed_at") - F.unix_micros("occurred_at")), "committed_at", "commit_hash")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return a.select("sid", "event_id", "n_own"), found.select("sid", "event_id", "repository_root", "commit_hash", "committed_at", "result_status", "occurred_at", "start_hash", "n", "place")


def uncontested(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """Candidates at whose time no other session of the repository is open.

    A sweep: beginnings count one up, ends one down (after what is asked at the same time), and a candidate reads the
    sum so far, its own session taken off. Sums run within a day of a repository, and over the sums of its days."""
    span = sessions.select("sid", "repository_root", "started_at", "ended_at").where("started_at IS NOT NULL AND repository_root IS NOT NULL AND (ended_at IS NULL OR ended_at >= started_at)")
    record = F.struct(*[F.col(f"`{c}`") for c in found.columns])
    none = F.lit(None).cast(found.select(record.alias("r")).schema["r"].dataType).alias("r")
    marks = span.select("repository_root", F.col("started_at").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("step"), none)
    marks = marks.unionByName(span.where("ended_at IS NOT NULL").select("repository_root", F.col("ended_at").alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("step"), none))
    line = marks.unionByName(found.select("repository_root", F.col("committed_at").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("step"), record.alias("r"))).withColumn("day", F.to_date("at"))
    days = line.groupBy("repository_root", "day").agg(F.sum("step").alias("steps"))
    earlier = F.coalesce(F.sum("steps").over(W.partitionBy("repository_root").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("step").over(W.partitionBy("repository_root", "day").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0))
    open_ = line.withColumn("inside", inside).where("turn = 1").join(days.select("repository_root", "day", earlier.alias("earlier")), ["repository_root", "day"])
    own = span.select("sid", F.col("repository_root").alias("own_root"), "started_at", "ended_at")
    asked = open_.select("r.*", (F.col("inside") + F.col("earlier")).alias("__open")).join(own.withColumnRenamed("sid", "__sid"), F.col("sid") == F.col("__sid"), "left")
    mine = F.coalesce((F.col("own_root") == F.col("repository_root")) & (F.col("started_at") <= F.col("committed_at")) & (F.col("ended_at").isNull() | (F.col("committed_at") <= F.col("ended_at"))), F.lit(False))
    return asked.where(F.col("__open") - mine.cast("int") <= 0).select(*[F.col(f"`{c}`") for c in found.columns])


def linked(actions: DataFrame, commits: DataFrame, sessions: DataFrame, per_action: int = 5, per_session: int = 20) -> tuple[DataFrame, DataFrame]:
    """(links, summary): sid, commit_hash, committed_at, tier, the best tier of each pair; and for each session with candidates how many were considered, kept and omitted.

    Of a session's LOW pairs the earliest per_session are kept; the summary counts the rest."""
    with scratch(commits.sparkSession) as tables:
        return _linked(actions, commits, sessions, per_action, per_session, tables)


def _linked(actions: DataFrame, commits: DataFrame, sessions: DataFrame, per_action: int, per_session: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    high = tables.put("high", by_hash(actions, commits))
    counts, found = nearest(actions.join(high, ["sid", "event_id"], "left_anti"), commits, max(per_action, 1), tables)
    found = tables.put("found", found)
    tables.drop("placed")
    single = found.where("n = 1 AND length(start_hash) >= 7")
    after = descends(single.select("commit_hash", F.lower("start_hash").alias("ancestor")).distinct(), commits)
    unique = tables.put("unique", single.join(after, (single.commit_hash == after.commit_hash) & (F.lower(single.start_hash) == after.ancestor), "left_semi"))
    medium = uncontested(unique.where("result_status = 'success'"), sessions)
    low = found.where(F.col("place") <= per_action).join(unique, ["event_id", "commit_hash"], "left_anti").unionByName(unique)
    times = commits.select("commit_hash", "repository_root", "committed_at")
    roots = actions.select("sid", "repository_root").distinct()
    every = high.join(roots, "sid").join(times, ["repository_root", "commit_hash"]).select("sid", "commit_hash", "committed_at", F.lit(3).alias("rank"))
    every = every.unionByName(medium.select("sid", "commit_hash", "committed_at", F.lit(2).alias("rank"))).unionByName(low.select("sid", "commit_hash", "committed_at", F.lit(1).alias("rank")))
    best = every.groupBy("sid", "commit_hash").agg(F.max("rank").alias("rank"), F.min("committed_at").alias("committed_at"))
    place = F.row_number().over(W.partitionBy("sid", F.col("rank") == 1).orderBy("committed_at", "commit_hash"))
    kept = written(best.withColumn("place", place).where((F.col("rank") > 1) | (F.col("place") <= per_session)).select("sid", "commit_hash", "committed_at", F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank")).alias("tier")))
    timed = kept.where("tier <> 'high'").groupBy("sid").agg(F.count("*").alias("kept"))
    summary = counts.groupBy("sid").agg(F.sum("n_own").alias("considered")).join(timed, "sid", "left").select("sid", "considered", F.coalesce("kept", F.lit(0)).alias("kept"), F.greatest(F.col("considered") - F.coalesce("kept", F.lit(0)), F.lit(0)).alias("omitted"))
    return kept, written(summary)


def report(links: DataFrame, summary: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: pairs by tier, distinct commits and sessions, tokens of linked sessions counted once each, tokens by confirmed commit, candidates considered and omitted."""
    tokens = links.where("tier <> 'low'").select("sid").distinct().join(usage, "sid").agg(F.sum("accounted.total_tokens").alias("tokens"))
    counts = links.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")], F.count_distinct("commit_hash").alias("commits"), F.count_distinct("sid").alias("sessions"), F.count_distinct(F.when(F.col("tier") != "low", F.col("commit_hash"))).alias("confirmed"))
    seen = summary.agg(F.coalesce(F.sum("considered"), F.lit(0)).alias("considered"), F.coalesce(F.sum("omitted"), F.lit(0)).alias("omitted"))
    return counts.crossJoin(tokens).crossJoin(seen).withColumn("tokens_per_confirmed", F.when(F.col("confirmed") > 0, F.col("tokens") / F.col("confirmed")))  # one row each
