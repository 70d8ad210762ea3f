"""Session catalogues and spawn edges, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names under which catalogues carry a concept, the preferred first.
SESSION = {
    "sid": ("id", "thread_id", "session_id", "conversation_id"),
    "path": ("rollout_path", "session_path", "file_path", "path"),
    "started_at": ("created_at", "start_time", "started_at"),
    "updated_at": ("updated_at", "modified_at", "ended_at"),
    "cwd": ("cwd", "working_directory"),
    "source": ("source",),
    "model": ("model",),
    "provider": ("model_provider", "provider"),
    "archived": ("archived", "is_archived"),
    "branch": ("git_branch",),
    "commit": ("git_sha",),
    "remote": ("git_origin_url",),
}
EDGE = {"parent": ("parent_thread_id", "parent_id", "parent"), "child": ("child_thread_id", "child_id", "child")}


def aliased(df: DataFrame, concepts: dict[str, tuple[str, ...]]) -> DataFrame:
    """A column for each concept: the first known name that df has (in any case), else null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[hit]}`") if (hit := next((n for n in names if n in have), None)) else F.lit(None)).cast("string").alias(k) for k, names in concepts.items()])


def timestamp(c: Column) -> Column:
    """Epoch seconds, milliseconds (beyond 1e10) or ISO text; a time without a zone is UTC."""
    n = F.expr("NULL") if c is None else c.try_cast("double")
    return F.coalesce(F.when(n > 1e10, F.timestamp_millis(n.cast("long"))).when(n.isNotNull(), F.timestamp_micros((n * 1_000_000).cast("long"))), F.try_to_timestamp(c))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def client(c: Column) -> Column:
    """cli, editor, subagent or other."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull(), None).when(t.startswith("{"), F.when(t.contains("subagent"), "subagent").otherwise("other")).when(t.isin("cli", "exec", "terminal"), "cli").when(t.isin("vscode", "editor", "ide"), "editor").otherwise("other")


def remote(c: Column) -> Column:
    """host/path of a remote: no credentials, no ``.git``; scp, ssh and https forms alike, a port kept."""
    t = F.regexp_replace(F.trim(c), r"^(?i)[a-z][a-z0-9+.-]*://", "url:")
    t = F.regexp_replace(t, r"^url:[^/@]*@", "url:")
    scp = F.regexp_replace(F.regexp_replace(t, r"^[^/@:]*@", ""), r"^([^/:]+):/?", "$1/")
    t = F.when(t.startswith("url:"), F.substring(t, 5, 100_000)).otherwise(scp)
    t = F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"(?:\.git)?/*$", "")
    host = F.lower(F.substring_index(t, "/", 1))
    return F.when(t.contains("/"), F.concat(host, F.substring(t, F.length(host) + 1, F.length(t))))


def sessions(df: DataFrame) -> DataFrame:
    """Normalized sessions; rows without an id go (count them with without_id)."""
    rows = aliased(df, SESSION).where("sid IS NOT NULL AND sid <> ''")
    identity = F.coalesce(F.concat(F.lit("remote:"), remote(F.col("remote"))), F.concat(F.lit("path:"), F.col("cwd")))
    return rows.select("sid", "path", timestamp(F.col("started_at")).alias("started_at"), timestamp(F.col("updated_at")).alias("ended_at"), F.col("cwd").alias("repository_root"), client(F.col("source")).alias("client_kind"), "model", "provider", truthy(F.col("archived")).alias("archived"), F.sha2(identity, 256).alias("repository_id"))


def without_id(df: DataFrame) -> int:
    return aliased(df, SESSION).where("sid IS NULL OR sid = ''").count()


def edges(df: DataFrame) -> DataFrame:
    return aliased(df, EDGE).where("parent IS NOT NULL AND child IS NOT NULL").distinct()


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """New metadata over old, known over unknown, the later end of both."""
    a, b = new.alias("a"), old.alias("b")
    rest = [c for c in new.columns if c not in ("sid", "ended_at")]
    return a.join(b, F.col("a.sid") == F.col("b.sid"), "full").select(F.coalesce("a.sid", "b.sid").alias("sid"), F.greatest("a.ended_at", "b.ended_at").alias("ended_at"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in rest])


def roles(columns: DataFrame) -> DataFrame:
    """columns (table, column) with the concept that each column's name stands for, null where none."""
    known = [(n, k) for names in (SESSION, EDGE) for k, ns in names.items() for n in ns]
    table = F.create_map(*[F.lit(x) for n, k in dict(known).items() for x in (n, k)])
    return columns.withColumn("role", table[F.lower("column")])


def recognized(columns: DataFrame) -> DataFrame:
    """(table, is_catalogue, is_edges, score): a catalogue has an id and a path or a time, edges a parent and a child; a table whose name tells of threads or sessions scores five more."""
    r = roles(columns).groupBy("table").agg(F.collect_set("role").alias("roles"))
    has = lambda k: F.array_contains("roles", k)
    named = F.when(F.lower("table").rlike("thread|session"), 5).otherwise(0)
    return r.select("table", (has("sid") & (has("path") | has("started_at") | has("updated_at"))).alias("is_catalogue"), (has("parent") & has("child")).alias("is_edges"), (F.size("roles") + named).alias("score"))


def layout(columns: DataFrame) -> DataFrame:
    """(table, fingerprint): equal for the same columns and types. columns: table, column, type."""
    return columns.groupBy("table").agg(F.sha2(F.to_json(F.sort_array(F.collect_set(F.struct(F.lower("column").alias("c"), "type")))), 256).alias("fingerprint"))


def chosen(rows: DataFrame, files: DataFrame, about: DataFrame, most: int = 1000) -> DataFrame:
    """(snapshot, rows, checked, valid, score, chosen): snapshots of a catalogue; the best has edges and times, references to files that are there, and many rows.

    rows: snapshot, sid, path; files: path; about: snapshot, has_edges, has_times, modified_at. The first
    references by id are checked; of equals the one with more of them, more rows, newer, of the smaller name."""
    there = files.select("path", F.lit(1).alias("there")).distinct()
    place = F.row_number().over(W.partitionBy("snapshot").orderBy("sid"))
    first = rows.where("path IS NOT NULL").withColumn("place", place).where(F.col("place") <= most).join(there, "path", "left")
    seen = first.groupBy("snapshot").agg(F.count("*").alias("checked"), F.count("there").alias("valid"))
    n = rows.groupBy("snapshot").agg(F.count("*").alias("rows"))
    bits = F.when(F.col("rows") > 0, F.floor(F.log2("rows")) + 1).otherwise(0)
    points = F.lit(50) + F.when(F.col("has_edges"), 5).otherwise(0) + F.when(F.col("has_times"), 5).otherwise(0) + F.when(F.col("checked") > 0, F.bround(30 * F.col("valid") / F.col("checked"))).otherwise(0) + F.least(F.lit(10), bits)
    scored = about.join(n, "snapshot").join(seen, "snapshot", "left").fillna(0, ["checked", "valid"]).withColumn("score", points.cast("long"))
    best = scored.agg(F.max_by("snapshot", F.struct("score", "valid", "rows", "modified_at")).alias("best"))
    return scored.crossJoin(best).select("snapshot", "rows", "checked", "valid", "score", (F.col("snapshot") == F.col("best")).alias("chosen"))  # one row


def placed(rows: DataFrame, home: str, files: DataFrame) -> DataFrame:
    """(sid, path, status): paths made absolute below home; outside_home, missing or present."""
    p = F.col("path")
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(home.rstrip("/") + "/"), p))
    flat = F.regexp_replace(whole, r"/(?:\./)+", "/")
    for _ in range(8):  # steps up, the innermost first
        flat = F.regexp_replace(flat, r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "")
    out = rows.select("sid", flat.alias("path"))
    there = files.select("path", F.lit(1).alias("there")).distinct()
    status = F.when(p.isNull(), "no_path").when(~p.startswith(home.rstrip("/") + "/"), "outside_home").when(F.col("there").isNull(), "missing").otherwise("present")
    return out.join(there, "path", "left").select("sid", "path", status.alias("status"))


def repositories(rows: DataFrame) -> DataFrame:
    """(repository_id, root, name, sessions, first_at, last_at): identities of sessions, with the newest row's root and name and the time that their commits can lie in (a day around).

    rows: sid, remote, common_dir, cwd, name, started_at, ended_at, path_exists."""
    evidence = F.coalesce(F.concat(F.lit("remote:"), remote(F.col("remote"))), F.concat(F.lit("git-dir:"), F.col("common_dir")), F.concat(F.lit("path:"), F.col("cwd")))
    newest = F.struct("path_exists", "started_at", "sid")
    day = F.expr("INTERVAL 1 DAY")
    by = rows.withColumn("repository_id", F.sha2(evidence, 256)).where("repository_id IS NOT NULL")
    return by.groupBy("repository_id").agg(F.max_by("cwd", newest).alias("root"), F.max_by("name", newest).alias("name"), F.count("*").alias("sessions"), (F.min("started_at") - day).alias("first_at"), (F.coalesce(F.max("ended_at"), F.max("started_at")) + day).alias("last_at"))
