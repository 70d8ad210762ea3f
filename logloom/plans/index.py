"""The session index over the driver's tables: built once, then kept up by what changed in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.checkpoints import checkpointed
from logloom.operators import commits, lineage, prompts, provenance, tasks, upkeep, usage
from logloom.operators.upkeep import Run, Store, Table, only

from . import views as X
from .more_queries import OUTCOMES, TASKS, actions_of, judged_of
from .queries import TOKENS, query
from .stored import is_written, state, written

SOURCES = ("conversations", "events")


def source(run: Run, name: str, keys: DataFrame | None) -> DataFrame:
    """Rows of the sessions in keys; the raw tables are read, what hangs on others' rows comes from the index."""
    spark, sf_dir = run.source
    if name == "events":
        return only(X.with_sid(spark, sf_dir), keys, "sid")
    return only(X.read(spark, sf_dir, "conversations"), keys, "conv_id")


def with_parents(run: Run, keys: DataFrame | None) -> DataFrame | None:
    if keys is None:
        return None
    return run.once("parents", keys, lambda: checkpointed(keys.select("sid").union(only(run.read("edges"), keys, "child").select("parent")).distinct()))


def with_ancestors(run: Run, keys: DataFrame | None) -> DataFrame | None:
    """The keys and everything above them."""
    if keys is None:
        return None
    return run.once("ancestors", keys, lambda: lineage.descendants(run.read("edges").select(F.col("child").alias("parent"), F.col("parent").alias("child")), keys))


def sessions(run: Run, keys: DataFrame | None) -> DataFrame:
    return X.sessions_of(source(run, "conversations", keys))


def edges(run: Run, keys: DataFrame | None) -> DataFrame:
    return X.edges_of(source(run, "conversations", keys))


def messages(run: Run, keys: DataFrame | None) -> DataFrame:
    own, above = source(run, "conversations", keys), source(run, "conversations", with_parents(run, keys))
    return X.messages_of(own, above, only(run.read("edges"), keys, "child"))


def totals(run: Run, keys: DataFrame | None) -> DataFrame:
    found = X.totals_of(source(run, "events", with_parents(run, keys)), only(run.read("edges"), keys, "child"))
    return only(found, keys, "sid")


def activity(run: Run, keys: DataFrame | None) -> DataFrame:
    return X.activity_of(source(run, "events", keys))


def history(run: Run, roots: DataFrame | None) -> DataFrame:
    acts = run.read("activity")
    if roots is not None:
        acts = only(acts.withColumn("root", X.repository_of(F.col("sid"))), roots, "root")
    return X.commits_of(acts)


def above(run: Run, keys: DataFrame | None) -> DataFrame:
    """Depths and cycles of the edges from the keys upwards; a cycle through a key lies above it."""
    return run.once("above", keys, lambda: checkpointed(lineage.ancestry(only(run.read("edges"), with_ancestors(run, keys), "child"))))


def verdicts(run: Run, keys: DataFrame | None) -> DataFrame:
    events = X.snapshots(only(run.read("totals"), with_parents(run, keys), "sid"))
    return lineage.edge_verdicts(events, only(run.read("edges"), keys, "child"), above(run, keys))


def accounted(run: Run, keys: DataFrame | None) -> DataFrame:
    observed = usage.session_totals(X.snapshots(only(run.read("totals"), keys, "sid")))
    return lineage.accounted(observed, only(run.read("verdicts"), keys, "child"))


def contributions(run: Run, keys: DataFrame | None) -> DataFrame:
    return usage.attributed(only(run.read("accounted"), keys, "sid"), X.snapshots(only(run.read("totals"), keys, "sid")))


def event_verdicts(run: Run, keys: DataFrame | None) -> DataFrame:
    return provenance.event_verdicts(only(run.read("messages"), with_parents(run, keys), "sid"), only(run.read("edges"), keys, "child"), above(run, keys))


def origins(run: Run, keys: DataFrame | None) -> DataFrame:
    up = with_ancestors(run, keys)
    found = provenance.origins(only(run.read("messages"), up, "sid"), only(run.read("event_verdicts"), up, "child"), only(run.read("edges"), up, "child"))
    return only(found, keys, "sid")


def links(run: Run, keys: DataFrame | None) -> DataFrame:
    """Links and summaries of sessions, from all that their repositories hold."""
    s, c, a = run.read("sessions"), run.read("commits"), run.read("activity")
    if keys is not None:
        roots = checkpointed(only(s, keys, "sid").select("repository_root").distinct())
        s = only(s, roots, "repository_root")
        c, a = only(c, roots, "repository_root"), only(a, s.select("sid"), "sid")
    found, summary = commits.linked(actions_of(s, c, a), c, s)
    return only(found.unionByName(summary, allowMissingColumns=True), keys, "sid")


def outcomes(run: Run, keys: DataFrame | None) -> DataFrame:
    return judged_of(only(run.read("activity"), keys, "sid"), only(run.read("links"), keys, "sid"))


def task_rows(run: Run, keys: DataFrame | None) -> DataFrame:
    logical = prompts.logical(only(run.read("messages"), keys, "sid"), only(run.read("origins"), keys, "sid"), only(run.read("sessions"), keys, "sid"))
    return tasks.classified(logical, only(run.read("activity"), keys, "sid"))


TABLES = {
    "sessions": Table(sessions),
    "edges": Table(edges, key="child"),
    "activity": Table(activity),
    "messages": Table(messages, needs=("edges",), spread="below"),
    "totals": Table(totals, needs=("edges",), spread="below"),
    "commits": Table(history, key="repository_root", domain="repository", needs=("sessions", "activity"), spread="repositories"),
    "verdicts": Table(verdicts, key="child", needs=("totals",), spread="below"),
    "accounted": Table(accounted, needs=("totals", "verdicts"), spread="below"),
    "contributions": Table(contributions, needs=("accounted",), spread="below"),
    "event_verdicts": Table(event_verdicts, key="child", needs=("messages",), spread="below"),
    "origins": Table(origins, needs=("event_verdicts",), spread="below"),
    "links": Table(links, needs=("commits",), spread="beside"),
    "outcomes": Table(outcomes, needs=("links",), spread="beside"),
    "tasks": Table(task_rows, needs=("origins", "activity"), spread="below"),
}


def below(run: Run, changed: DataFrame) -> DataFrame:
    """Changed sessions and those below them, by the edges of before and of now."""
    both = run.read("edges")
    old = run.before("edges")
    return lineage.descendants(both if old is None else both.unionByName(old).distinct(), changed)


def repositories(run: Run, changed: DataFrame) -> DataFrame:
    """Those of changed sessions, before and now, and those that their commits went to."""
    roots = only(run.read("sessions"), changed, "sid").select("repository_root")
    old = run.before("sessions")
    if old is not None:
        roots = roots.union(only(old, changed, "sid").select("repository_root"))
    return roots.union(changed.select(X.repository_of(F.col("sid")))).where("repository_root IS NOT NULL").distinct()


def beside(run: Run, changed: DataFrame) -> DataFrame:
    """All sessions of the touched repositories, and the changed ones."""
    return only(run.read("sessions"), repositories(run, changed), "repository_root").select("sid").union(changed).distinct()


SPREADS = {"below": below, "repositories": repositories, "beside": beside}
FILES = {"files": ("path", "path string, size long, modified_at timestamp"), "states": ("sid", "sid long, path string, n long, digest long")}


def states(spark: SparkSession, sf_dir: str, paths: list[str] | None) -> DataFrame:
    """(sid, path, n, digest): what each file holds of each session, order apart; of the named files only, if given."""
    n = X.read(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    found = None
    for name, sid in (("conversations", F.col("conv_id")), ("events", F.col("user_id"))):
        at = [p for p in paths if f"/{name}.parquet" in p] if paths is not None else [f"{sf_dir}/{name}.parquet"]
        if not at:
            continue
        rows = spark.read.parquet(*at)
        rows = rows.select("*", F.col("_metadata.file_path").alias("path")).join(F.broadcast(n))  # one row
        sid = sid if name == "conversations" else sid % F.col("n")
        row = F.xxhash64(*[c for c in rows.columns if c not in ("path", "n")])
        part = rows.groupBy(sid.alias("sid"), "path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(row, F.lit(name))).alias("digest"))
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], FILES["states"][1]) if found is None else found


def update(spark: SparkSession, sf_dir: str, folder: str, tables: dict[str, Table] | None = None) -> Run | None:
    """Brings the index in folder to the state of the sources; None if no file and no table's version changed.

    The first run makes everything. After it only files that are new, changed or gone are read for what they hold
    of each session; sessions that differ there are the change."""
    store, tables = Store(spark, folder), dict(tables or TABLES)
    now = checkpointed(upkeep.listing(spark, [f"{sf_dir}/{name}.parquet" for name in SOURCES]))
    before, known = store.read("files"), store.read("states")
    if before is None or known is None:
        store.buckets = upkeep.buckets_for(now.agg(F.sum("size")).first()[0] or 0)
        changed, kept_states, held = None, None, states(spark, sf_dir, None)
    else:
        stale = {n for (n, _), (_, _, v) in store.manifest.items() if n in tables and v != tables[n].version} | (tables.keys() - store.schemas.keys())
        touched = upkeep.file_changes(now, before).collect()  # a row for each file that changed
        if not touched and not stale:
            return None
        paths = [r["path"] for r in touched if r["state"] != "gone"]
        held = checkpointed(states(spark, sf_dir, paths))
        names = spark.createDataFrame([(r["path"],) for r in touched], "path string")
        was = known.join(names, "path", "left_semi")
        changed, seen = checkpointed(upkeep.changed_keys(held, was)), held.select("sid").union(was.select("sid"))
        kept_states = known.join(names, "path", "left_anti")

    def files(run: Run, keys: DataFrame | None) -> DataFrame:
        return only(now.select("path", "size", "modified_at"), keys, "path")

    def all_states(run: Run, keys: DataFrame | None) -> DataFrame:
        fresh = held.select("sid", "path", "n", "digest")
        return fresh if kept_states is None else only(fresh.unionByName(kept_states), keys, "sid")

    own = {"files": Table(files, key="path", domain="file", spread="files"), "states": Table(all_states, spread="seen")}
    spread_files = {"files": lambda run, keys: names, "seen": lambda run, keys: seen}
    return upkeep.upkeep(store, (spark, sf_dir), tables | own, changed, SPREADS | spread_files)


# ---- queries: an index of the state before a change, brought up to the tables as they are

def grown(spark: SparkSession, sf_dir: str) -> int:
    """The session that the change is about: the one of the most turns, the smallest of those."""
    return X.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "conv_id").first()[0]


def earlier(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the sources as they were before that session went on: without its last turn and its last event."""

    def write(path: str) -> None:
        sid = grown(spark, sf_dir)
        conv, events = X.read(spark, sf_dir, "conversations"), X.with_sid(spark, sf_dir)
        turn = conv.where(F.col("conv_id") == sid).agg(F.max("turn")).first()[0]
        last = events.where(F.col("sid") == sid).agg(F.max(F.struct("ts", "event_id"))["event_id"]).first()[0]
        conv.where((F.col("conv_id") != sid) | (F.col("turn") != turn)).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
        events.where(F.col("event_id") != F.lit(-1 if last is None else last)).drop("sid", "n").write.mode("overwrite").parquet(f"{path}/events.parquet")

    return written(spark, sf_dir, "earlier", write)


def kept_up(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """The folder of an index that was built of the earlier state and then brought up to the present one.

    Where names are given and the whole index isn't there yet, it has those tables and what they are made of."""
    whole = f"index-{state(spark, sf_dir)}"
    some = names and not is_written(spark, sf_dir, whole)
    tables = upkeep.with_needs(TABLES, names) if some else TABLES

    def write(path: str) -> None:
        update(spark, earlier(spark, sf_dir), path, tables)
        update(spark, sf_dir, path, tables)

    return written(spark, sf_dir, "-".join((whole, *tables)) if some else whole, write)


@query(
    """SELECT s.sid, s.repository_root, ac.observed, ac.lineage, ac.accounted, c.parts, m.events, r.inherited, l.links, oc.outcome, tk.action, tk.domain
    FROM fx_sessions s LEFT JOIN ac USING (sid) LEFT JOIN (SELECT sid, count(*) AS parts FROM ct GROUP BY sid) c USING (sid) LEFT JOIN (SELECT sid, count(*) AS events FROM fx_messages GROUP BY sid) m USING (sid)
    LEFT JOIN (SELECT sid, count(*) FILTER (status LIKE 'inherited%') AS inherited FROM re GROUP BY sid) r USING (sid) LEFT JOIN (SELECT sid, count(*) AS links FROM tl GROUP BY sid) l USING (sid)
    LEFT JOIN oc USING (sid) LEFT JOIN tk USING (sid)""",
    **(TOKENS | TASKS | OUTCOMES),
)
def index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by an index that one changed session was followed through, against everything made anew."""
    store = Store(spark, kept_up(spark, sf_dir))
    count = lambda name, what, n: store.read(name).groupBy("sid").agg(what.alias(n))
    a = store.read("accounted").select("sid", F.col("observed.total_tokens").alias("observed"), "lineage", F.col("accounted.total_tokens").alias("accounted"))
    rows = store.read("sessions").select("sid", "repository_root").join(a, "sid", "left")
    rows = rows.join(count("contributions", F.count("*"), "parts"), "sid", "left").join(count("messages", F.count("*"), "events"), "sid", "left")
    rows = rows.join(count("origins", F.count_if(F.col("status").startswith("inherited")), "inherited"), "sid", "left")
    rows = rows.join(store.read("links").where("commit_hash IS NOT NULL").groupBy("sid").agg(F.count("*").alias("links")), "sid", "left")
    return rows.join(store.read("outcomes").select("sid", "outcome"), "sid", "left").join(store.read("tasks").select("sid", "action", "domain"), "sid", "left")


@query(
    """SELECT 'changed' AS reached, sid FROM chosen UNION ALL
      SELECT 'below', sid FROM (WITH RECURSIVE d AS (SELECT sid FROM chosen UNION SELECT child FROM d JOIN fx_edges ON parent = d.sid) SELECT sid FROM d) UNION ALL
      SELECT 'beside', sid FROM fx_sessions WHERE sid IN (SELECT sid FROM chosen) OR repository_root IN (SELECT '/repos/repo-' || (sid % 8) FROM chosen)""",
    chosen="SELECT conv_id AS sid FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 1",
)
def index_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that the change reaches: itself, those below it, those of its repository."""
    store = Store(spark, kept_up(spark, sf_dir))
    run = Run(store, (spark, sf_dir), store.run, store.manifest)
    changed = checkpointed(upkeep.changed_keys(states(spark, sf_dir, None), states(spark, earlier(spark, sf_dir), None)))
    parts = {"changed": changed, "below": below(run, changed), "beside": beside(run, changed)}
    found = [df.select(F.lit(name).alias("reached"), "sid") for name, df in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])

