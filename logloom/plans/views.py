"""The driver's tables seen as session telemetry: sessions, spawn edges, messages, token events, activity, commits.

SQL holds the same definitions for DuckDB, as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.vectors import FIELDS

from .stored import stored

START = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Times without a zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def later(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + minutes.cast("long") * 60_000_000)


def sessions_of(conv: DataFrame) -> DataFrame:
    sid = F.col("sid")
    turns = conv.groupBy(F.col("conv_id").alias("sid")).agg(F.max("turn").alias("last"))
    started = later(F.lit(START).cast("timestamp"), 11 * sid)
    return turns.select(
        "sid",
        started.alias("started_at"),
        F.when(sid % 13 != 0, later(started, F.col("last") + 1)).alias("ended_at"),
        F.when(sid % 7 != 0, F.concat(F.lit("/repos/repo-"), sid % 8)).alias("repository_root"),
        F.when(sid % 11 != 0, F.concat(F.lit("model-"), sid % 4)).alias("model"),
        F.when((sid % 5 == 0) & (sid > 0), "subagent").when(sid % 2 == 0, "cli").otherwise("editor").alias("client_kind"),
    )


@stored
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_of(read(spark, sf_dir, "conversations"))


#: children and their parents
ODD = {1: [900000001], 2: [3], 3: [2], 6: [8, 9], 7: [6], 8: [7], 12: [11, 13], 14: [12], 16: [7]}


def edges_of(conv: DataFrame) -> DataFrame:
    """Spawn edges: among them an orphan, a cycle of two, one of three that another parent leads into, one below that, and a child of two parents with one below it."""
    sid = F.col("conv_id")
    ids = conv.select("conv_id").distinct()
    spawned = ids.where((sid % 5 == 0) & (sid > 0)).select(F.when(sid % 25 == 0, sid - 5).otherwise(sid - 1).alias("parent"), sid.alias("child"))
    pairs = F.create_map(*[x for child, parents in ODD.items() for x in (F.lit(child).cast("long"), F.array(*[F.lit(p).cast("long") for p in parents]))])
    odd = ids.where(sid.isin(*ODD)).select(F.explode(pairs[sid]).alias("parent"), sid.alias("child"))
    return spawned.union(odd)


@stored
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And one edge between two sessions that the catalogue doesn't have."""
    found = edges_of(read(spark, sf_dir, "conversations"))
    return found.union(spark.createDataFrame([(900000003, 900000002)], found.schema))


def messages_of(conv: DataFrame, above: DataFrame, edges: DataFrame) -> DataFrame:
    """Events of a session in order; every second child first replays three turns of its parent (of the turns above)."""
    turns = lambda df: df.select(F.col("conv_id").alias("sid"), F.lit(1).alias("own"), "turn", "role", "text")
    replay = edges.where("child % 10 = 0").join(turns(above).withColumnRenamed("sid", "parent").where("turn < 3"), "parent")
    every = turns(conv).union(replay.select(F.col("child").alias("sid"), F.lit(0).alias("own"), "turn", "role", "text"))
    place = F.row_number().over(W.partitionBy("sid").orderBy("own", "turn")) - 1
    return every.select("sid", place.alias("source_ordinal"), F.concat("role", F.lit("_message")).alias("family"), F.sha2(F.concat_ws("|", "role", "text"), 256).alias("fingerprint"), "text")


@stored
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations")
    return messages_of(conv, conv, edges(spark, sf_dir))


def with_sid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events with their session."""
    conv = read(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    return read(spark, sf_dir, "events").join(F.broadcast(conv)).withColumn("sid", F.col("user_id") % F.col("n"))  # one row


def totals_of(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Cumulative snapshots of a session; every second child first replays four of its parent's and goes on from them.

    events: those of the sessions and their parents, with their sid."""
    order = W.partitionBy("sid").orderBy("ts", "event_id")
    own = events.select("sid", "ts", "event_id", F.floor(100 * F.col("value")).alias("inc"))
    own = own.select("sid", "ts", F.sum("inc").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("total"), (F.row_number().over(order) - 1).alias("k"))
    first = own.where("k < 4").select(F.col("sid").alias("parent"), "ts", "total", "k")
    replay = edges.where("child % 10 = 0").join(first, "parent")
    base = replay.groupBy(F.col("child").alias("sid")).agg(F.max("total").alias("base"), F.count("*").alias("shift"))
    shifted = own.join(base, "sid", "left").select("sid", "ts", (F.col("total") + F.coalesce("base", F.lit(0))).alias("total"), (F.col("k") + F.coalesce("shift", F.lit(0))).alias("k"))
    return shifted.union(replay.select(F.col("child").alias("sid"), "ts", "total", "k")).select("sid", F.col("k").alias("event_ordinal"), F.col("ts").alias("occurred_at"), F.col("total").alias("cumulative_total"))


@stored
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals_of(with_sid(spark, sf_dir), edges(spark, sf_dir))


def snapshots(totals: DataFrame) -> DataFrame:
    total = F.struct(*[(F.col("cumulative_total") if f == "total_tokens" else F.lit(None)).cast("long").alias(f) for f in FIELDS])
    return totals.select("sid", "event_ordinal", "occurred_at", total.alias("cumulative"))


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(token_totals(spark, sf_dir))


def activity_of(events: DataFrame) -> DataFrame:
    kind = F.create_map(*map(F.lit, ("view", "git_inspection", "purchase", "git_mutation", "signup", "editing_patching", "click", "testing", "error", "other")))
    return events.select(
        "event_id",
        "sid",
        F.col("ts").alias("occurred_at"),
        kind[F.col("event_type")].alias("command_category"),
        F.when(F.col("value") < 5, "unknown").when(F.col("value") < 30, "success").otherwise("failure").alias("result_status"),
    )


@stored
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_of(with_sid(spark, sf_dir))


def repository_of(sid: Column) -> Column:
    return F.concat(F.lit("/repos/repo-"), sid % 8)


def commits_of(activity: DataFrame) -> DataFrame:
    """A commit three minutes after each action. Of every four of a repository the third is made on a branch beside the second, and the fourth merges it."""
    acts = activity.where("command_category = 'git_mutation'")
    rows = acts.select(F.sha2(F.concat(F.lit("c"), F.col("event_id").cast("string")), 256).alias("commit_hash"), repository_of(F.col("sid")).alias("repository_root"), later(F.col("occurred_at"), F.lit(3)).alias("committed_at"))
    order = W.partitionBy("repository_root").orderBy("committed_at", "commit_hash")
    k, one, two = (F.row_number().over(order) - 1) % 4, F.lag("commit_hash").over(order), F.lag("commit_hash", 2).over(order)
    parents = F.when(k == 2, F.array(two)).when(k == 3, F.array(two, one)).otherwise(F.array(one))
    return rows.withColumn("parents", F.array_compact(parents))


@stored
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits_of(activity(spark, sf_dir))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), "text", F.col("source").alias("repository"), F.col("lang").alias("model"))


SQL = {
    "fx_sessions": """
      SELECT conv_id AS sid, TIMESTAMP '2024-01-01' + to_minutes(11 * conv_id) AS started_at,
        CASE WHEN conv_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(11 * conv_id + max(turn) + 1) END AS ended_at,
        CASE WHEN conv_id % 7 <> 0 THEN '/repos/repo-' || (conv_id % 8) END AS repository_root,
        CASE WHEN conv_id % 11 <> 0 THEN 'model-' || (conv_id % 4) END AS model,
        CASE WHEN conv_id % 5 = 0 AND conv_id > 0 THEN 'subagent' WHEN conv_id % 2 = 0 THEN 'cli' ELSE 'editor' END AS client_kind
      FROM conversations GROUP BY conv_id""",
    "fx_edges": """
      SELECT DISTINCT CASE WHEN conv_id % 25 = 0 THEN conv_id - 5 ELSE conv_id - 1 END AS parent, conv_id AS child FROM conversations WHERE conv_id % 5 = 0 AND conv_id > 0
      UNION ALL SELECT p, c FROM (VALUES (900000001, 1), (3, 2), (2, 3), (8, 6), (9, 6), (6, 7), (7, 8), (11, 12), (13, 12), (12, 14), (7, 16)) t(p, c) WHERE c IN (SELECT conv_id FROM conversations)
      UNION ALL SELECT 900000003, 900000002""",
    "fx_messages": """
      SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY own, turn) - 1 AS source_ordinal, role || '_message' AS family, sha256(role || '|' || text) AS fingerprint, text
      FROM (SELECT conv_id AS sid, 1 AS own, turn, role, text FROM conversations
        UNION ALL SELECT child, 0, turn, role, text FROM fx_edges JOIN conversations ON conv_id = parent WHERE child % 10 = 0 AND turn < 3)""",
    "fx_own": """
      SELECT user_id % (SELECT max(conv_id) + 1 FROM conversations) AS sid, ts, sum(CAST(floor(100 * value) AS BIGINT)) OVER w AS total, row_number() OVER w - 1 AS k
      FROM events WINDOW w AS (PARTITION BY user_id % (SELECT max(conv_id) + 1 FROM conversations) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "fx_replay": "SELECT child AS sid, ts, total, k FROM fx_edges JOIN fx_own ON sid = parent WHERE child % 10 = 0 AND k < 4",
    "fx_token_events": """
      SELECT sid, CAST(k AS BIGINT) AS event_ordinal, ts AS occurred_at, CAST(total AS BIGINT) AS cumulative_total FROM fx_replay
      UNION ALL SELECT o.sid, CAST(o.k + coalesce(b.n, 0) AS BIGINT), o.ts, CAST(o.total + coalesce(b.base, 0) AS BIGINT)
      FROM fx_own o LEFT JOIN (SELECT sid, max(total) AS base, count(*) AS n FROM fx_replay GROUP BY sid) b USING (sid)""",
    "fx_activity": """
      SELECT event_id, user_id % (SELECT max(conv_id) + 1 FROM conversations) AS sid, ts AS occurred_at,
        CASE event_type WHEN 'view' THEN 'git_inspection' WHEN 'purchase' THEN 'git_mutation' WHEN 'signup' THEN 'editing_patching' WHEN 'click' THEN 'testing' WHEN 'error' THEN 'other' END AS command_category,
        CASE WHEN value < 5 THEN 'unknown' WHEN value < 30 THEN 'success' ELSE 'failure' END AS result_status FROM events""",
    "fx_commits": """
      SELECT *, list_filter(CASE (row_number() OVER h - 1) % 4 WHEN 2 THEN [lag(commit_hash, 2) OVER h] WHEN 3 THEN [lag(commit_hash, 2) OVER h, lag(commit_hash) OVER h] ELSE [lag(commit_hash) OVER h] END, lambda p: p IS NOT NULL) AS parents
      FROM (SELECT sha256('c' || event_id) AS commit_hash, '/repos/repo-' || (sid % 8) AS repository_root, occurred_at + INTERVAL 3 MINUTE AS committed_at FROM fx_activity WHERE command_category = 'git_mutation')
      WINDOW h AS (PARTITION BY repository_root ORDER BY committed_at, commit_hash)""",
    "fx_prompts": "SELECT doc_id AS prompt_id, text, source AS repository, lang AS model FROM documents",
}


RECURSIVE = ("up", "tr", "dp", "vu", "vd_", "anc")


def with_views(query: str, **more: str) -> str:
    """The query behind the definitions, and those given besides."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({body})" for name, body in (SQL | more).items()) + "\n" + query
