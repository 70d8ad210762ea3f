"""The registered queries over the views of the driver's tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import lineage, provenance, sessions, usage

from . import views as X
from .stored import one_state, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **more: str) -> Callable:
    """Registers a query, and its SQL over the views."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with one_state(spark, sf_dir):
                return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = X.with_views(sql, **more)
        return run

    return keep


@stored
def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.session_totals(X.token_events(spark, sf_dir))


@stored
def thread_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.ancestry(X.edges(spark, sf_dir))


@stored
def edge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edge_verdicts(X.token_events(spark, sf_dir), X.edges(spark, sf_dir), thread_ancestry(spark, sf_dir))


@stored
def accounted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.accounted(observed(spark, sf_dir), edge_verdicts(spark, sf_dir))


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sessions(spark, sf_dir).join(accounted_sessions(spark, sf_dir), "sid", "left")


@stored
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.attributed(accounted_sessions(spark, sf_dir), X.token_events(spark, sf_dir))


# the last snapshot of each session, and the verdict of each edge: the longest run along a diagonal
TOKENS = {
    "o": "SELECT sid, arg_max(cumulative_total, event_ordinal) AS observed FROM fx_token_events GROUP BY sid",
    "e1": "SELECT child, min(parent) AS parent FROM fx_edges GROUP BY child HAVING count(*) = 1",
    "up": "SELECT child AS node, parent AS top FROM fx_edges UNION SELECT u.node, e.parent FROM up u JOIN fx_edges e ON e.child = u.top",
    "cyc": "SELECT DISTINCT node FROM up WHERE node = top",
    "dp": "SELECT parent AS node, 0 AS d FROM fx_edges WHERE parent NOT IN (SELECT child FROM fx_edges) UNION SELECT e.child, dp.d + 1 FROM dp JOIN fx_edges e ON e.parent = dp.node WHERE dp.node NOT IN (SELECT node FROM cyc)",
    "ti": "SELECT sid, cumulative_total AS v, row_number() OVER (PARTITION BY sid ORDER BY event_ordinal) - 1 AS i FROM fx_token_events",
    "st": "SELECT e.parent, e.child, p.i AS s FROM e1 e JOIN ti p ON p.sid = e.parent JOIN ti c ON c.sid = e.child AND c.i = 0 AND c.v = p.v",
    "dg": "SELECT st.parent, st.child, st.s, c.i, row_number() OVER (PARTITION BY st.parent, st.child, st.s ORDER BY c.i) - 1 AS r FROM st JOIN ti c ON c.sid = st.child JOIN ti p ON p.sid = st.parent AND p.i = st.s + c.i AND p.v = c.v",
    "rn": "SELECT parent, child, s, count(*) AS n FROM dg WHERE r = i GROUP BY parent, child, s",
    "bs": "SELECT parent, child, arg_max(s, n * 1000000 - s) AS s, max(n) AS n FROM rn GROUP BY parent, child",
    "ends": "SELECT sid, arg_min(v, i) AS first, arg_max(v, i) AS last FROM ti GROUP BY sid",
    "vd": """
      SELECT e.parent, e.child, c.first, c.last, b.n, q.v AS run_end, CASE
        WHEN e.child IN (SELECT node FROM cyc) OR e.parent IN (SELECT node FROM cyc) THEN 'cycle' WHEN c.sid IS NULL THEN 'unavailable' WHEN p.sid IS NULL THEN 'ambiguous'
        WHEN b.n >= 2 AND c.last >= q.v THEN 'inherited_prefix' WHEN c.first = p.last AND c.last >= c.first THEN 'inherited_exact'
        WHEN c.first = 0 THEN 'independent' ELSE 'ambiguous' END AS status
      FROM e1 e LEFT JOIN ends c ON c.sid = e.child LEFT JOIN ends p ON p.sid = e.parent LEFT JOIN bs b ON b.parent = e.parent AND b.child = e.child LEFT JOIN ti q ON q.sid = e.parent AND q.i = b.s + b.n - 1""",
    "ac": """
      SELECT o.sid, o.observed, coalesce(v.status, 'root') AS lineage,
        CASE v.status WHEN 'inherited_prefix' THEN v.run_end WHEN 'inherited_exact' THEN v.first END AS baseline,
        CASE v.status WHEN 'inherited_prefix' THEN v.last - v.run_end WHEN 'inherited_exact' THEN v.last - v.first ELSE o.observed END AS accounted
      FROM o LEFT JOIN vd v ON v.child = o.sid""",
    "sc": "SELECT s.*, ac.observed, ac.lineage, ac.baseline, ac.accounted FROM fx_sessions s LEFT JOIN ac USING (sid)",
    # attribution of cumulative snapshots; those of the views never fall
    "ad": "SELECT t.sid, t.event_ordinal, t.occurred_at, greatest(t.cumulative_total - coalesce(ac.baseline, 0), 0) AS a, ac.accounted FROM fx_token_events t JOIN ac USING (sid)",
    "ai": "SELECT *, a - coalesce(lag(a) OVER (PARTITION BY sid ORDER BY event_ordinal), 0) AS inc, max(occurred_at) OVER (PARTITION BY sid ORDER BY event_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, lag(occurred_at) OVER (PARTITION BY sid ORDER BY event_ordinal) AS prev FROM ad",
    "aj": "SELECT sid, bool_or(coalesce(occurred_at < prev, false)) AS back, sum(CASE WHEN inc > 0 THEN inc END) AS s, any_value(accounted) AS accounted FROM ai GROUP BY sid",
    "ct": """
      SELECT ai.sid, ai.occurred_at, ai.inc AS tokens, 'complete' AS status, NULL::VARCHAR AS reason FROM ai JOIN aj USING (sid) WHERE NOT back AND s IS NOT DISTINCT FROM aj.accounted AND inc > 0
      UNION ALL SELECT sid, NULL, accounted, 'fallback', CASE WHEN back THEN 'nonmonotonic_event_timestamps' ELSE 'event_total_mismatch' END FROM aj WHERE back OR s IS DISTINCT FROM accounted""",
}


@query(
    """SELECT sid, epoch(started_at)::BIGINT AS started, client_kind, coalesce(split_part(repository_root, '/', 3), 'Outside Git repositories') AS repository,
      CASE WHEN ended_at >= started_at THEN epoch(ended_at)::BIGINT - epoch(started_at)::BIGINT END AS seconds, o.observed AS total_tokens, n AS events
    FROM fx_sessions LEFT JOIN o USING (sid) LEFT JOIN (SELECT sid, count(*) AS n FROM fx_messages GROUP BY sid) USING (sid)
    WHERE client_kind <> 'subagent' AND (repository_root IS NOT NULL OR model IS NOT NULL) AND started_at >= TIMESTAMP '2024-01-01 01:00:00'
    ORDER BY started_at DESC NULLS LAST, sid LIMIT 50""",
    **TOKENS,
)
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty sessions that a user began."""
    s = X.sessions(spark, sf_dir).where(sessions.in_window(F.col("started_at"), since=datetime(2024, 1, 1, 1)) & (F.col("client_kind") != "subagent"))
    s = s.where(~sessions.of_repository("none", F.col("repository_root")) | ~sessions.of_model("unknown", F.col("model")))
    rows = sessions.listed(s, observed(spark, sf_dir), X.messages(spark, sf_dir), 50)
    return rows.select("sid", F.unix_timestamp("started_at").alias("started"), "client_kind", sessions.label(F.col("repository_root")).alias("repository"), sessions.duration(F.col("started_at"), F.col("ended_at")).alias("seconds"), "total_tokens", "events")


@query("SELECT repository_root, count(*) AS sessions, epoch(min(started_at))::BIGINT AS first_at, epoch(max(started_at))::BIGINT AS latest_at, sum(observed)::BIGINT AS tokens, count(observed) AS known_sessions, count(DISTINCT model) AS models FROM sc GROUP BY repository_root", **TOKENS)
def repository_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.repositories(X.sessions(spark, sf_dir), observed(spark, sf_dir))
    return rows.withColumns({c: F.unix_timestamp(c) for c in ("first_at", "latest_at")})


@query("SELECT model, count(*) AS sessions, epoch(max(started_at))::BIGINT AS latest_at, sum(observed)::BIGINT AS tokens, count(observed) AS known_sessions, count(DISTINCT repository_root) AS repositories FROM sc GROUP BY model", **TOKENS)
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.models(X.sessions(spark, sf_dir), observed(spark, sf_dir)).withColumn("latest_at", F.unix_timestamp("latest_at"))


NOW = datetime(2024, 1, 2, 12)


@query(
    """SELECT count(*) AS sessions, count(DISTINCT started_at::DATE) AS active_days, count(DISTINCT repository_root) AS repositories, count(*) FILTER (started_at::DATE = DATE '2024-01-02') AS today,
      count(*) FILTER (started_at >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 7 DAY AND started_at < TIMESTAMP '2024-01-02 12:00:00') AS last_7_days,
      count(*) FILTER (started_at >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 30 DAY AND started_at < TIMESTAMP '2024-01-02 12:00:00') AS last_30_days,
      sum(observed)::BIGINT AS tokens, count(observed) AS known_sessions FROM sc""",
    **TOKENS,
)
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.overview(X.sessions(spark, sf_dir), observed(spark, sf_dir), NOW)


@stored
def topology_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.topology(X.sessions(spark, sf_dir), X.edges(spark, sf_dir))


VALID = {
    "ve": "SELECT DISTINCT parent, child FROM fx_edges WHERE parent IN (SELECT sid FROM fx_sessions) AND child IN (SELECT sid FROM fx_sessions)",
    "vu": "SELECT child AS node, parent AS top FROM ve UNION SELECT u.node, e.parent FROM vu u JOIN ve e ON e.child = u.top",
    "vc": "SELECT DISTINCT node FROM vu WHERE node = top",
    "vd_": "SELECT sid AS root, sid AS node, 0 AS d FROM fx_sessions WHERE sid NOT IN (SELECT child FROM ve) UNION SELECT v.root, e.child, v.d + 1 FROM vd_ v JOIN ve e ON e.parent = v.node WHERE v.node NOT IN (SELECT node FROM vc)",
}


@query(
    """SELECT (SELECT count(*) FROM fx_sessions) AS sessions, (SELECT count(*) FROM fx_sessions WHERE sid NOT IN (SELECT child FROM ve)) AS roots, count(*) AS edges, (SELECT count(*) FROM ve) AS valid_edges, (SELECT count(DISTINCT child) FROM ve) AS children,
      count(*) FILTER (parent NOT IN (SELECT sid FROM fx_sessions)) AS orphan_parents, count(*) FILTER (child NOT IN (SELECT sid FROM fx_sessions)) AS orphan_children, count(*) FILTER (parent = child) AS self_edges,
      (SELECT count(*) FROM (SELECT child FROM ve GROUP BY child HAVING count(*) > 1)) AS several_parents, (SELECT count(*) FROM vc) AS cycle_nodes, (SELECT max(d)::BIGINT FROM vd_) AS depth,
      (SELECT count(DISTINCT root) FROM vd_ WHERE d >= 2) AS multi_generation_trees FROM fx_edges""",
    **VALID,
)
def thread_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology_row(spark, sf_dir)


@query(
    """SELECT n.node, CASE WHEN node NOT IN (SELECT node FROM cyc) THEN d END::BIGINT AS depth, node IN (SELECT node FROM cyc) OR node IN (SELECT node FROM up WHERE top IN (SELECT node FROM cyc)) AS cyclic, node IN (SELECT node FROM cyc) AS on_cycle
      FROM (SELECT child AS node FROM fx_edges UNION SELECT parent FROM fx_edges) n LEFT JOIN (SELECT node, max(d) AS d FROM dp GROUP BY node) USING (node)""",
    **TOKENS,
)
def thread_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread_ancestry(spark, sf_dir)


@query("SELECT DISTINCT sid FROM (WITH RECURSIVE d AS (SELECT sid FROM fx_sessions WHERE sid % 25 = 4 UNION SELECT child FROM d JOIN fx_edges ON parent = d.sid) SELECT sid FROM d)")
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.descendants(X.edges(spark, sf_dir), X.sessions(spark, sf_dir).where("sid % 25 = 4"))


@query("SELECT parent, child, status, CASE status WHEN 'inherited_prefix' THEN n WHEN 'inherited_exact' THEN 1 WHEN 'independent' THEN 1 END::BIGINT AS matched, CASE status WHEN 'inherited_prefix' THEN run_end WHEN 'inherited_exact' THEN first WHEN 'independent' THEN first END AS baseline, CASE status WHEN 'inherited_prefix' THEN last - run_end WHEN 'inherited_exact' THEN last - first WHEN 'independent' THEN last END AS incremental, 'unavailable' AS deltas FROM vd", **TOKENS)
def token_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = edge_verdicts(spark, sf_dir)
    return v.select("parent", "child", "status", "matched", F.col("baseline.total_tokens").alias("baseline"), F.col("incremental.total_tokens").alias("incremental"), "deltas")


@query("SELECT * FROM ac", **TOKENS)
def accounted_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounted_sessions(spark, sf_dir).select("sid", F.col("observed.total_tokens").alias("observed"), "lineage", F.col("baseline.total_tokens").alias("baseline"), F.col("accounted.total_tokens").alias("accounted"))


GROUPED = "count(*) AS sessions, sum(accounted)::BIGINT AS tokens, count(accounted) AS known_sessions, avg(observed) AS mean_tokens, median(observed) AS median_tokens, quantile_disc(observed, 0.9) AS p90_tokens"


@query(f"SELECT {GROUPED} FROM sc", **TOKENS)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_dimension(scoped(spark, sf_dir))


@query(f"SELECT repository_root, {GROUPED} FROM sc GROUP BY repository_root", **TOKENS)
def usage_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_dimension(scoped(spark, sf_dir), "repository_root")


@query(f"SELECT model, {GROUPED} FROM sc GROUP BY model", **TOKENS)
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_dimension(scoped(spark, sf_dir), "model")


def _period_sql(p: str) -> str:
    return f"""SELECT strftime(coalesce(s.p, t.p), '%Y-%m-%d') AS period, coalesce(s.n, 0) AS sessions, t.tokens, coalesce(t.n, 0) AS contributing_sessions
      FROM (SELECT {p.format("started_at")} AS p, count(*) AS n FROM fx_sessions GROUP BY 1) s
      FULL JOIN (SELECT {p.format("occurred_at")} AS p, sum(tokens)::BIGINT AS tokens, count(DISTINCT sid) AS n FROM ct WHERE sid IN (SELECT sid FROM fx_sessions) GROUP BY 1) t ON s.p IS NOT DISTINCT FROM t.p"""


@query(_period_sql("{}::DATE"), **TOKENS)
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_period(scoped(spark, sf_dir), contributions(spark, sf_dir), "day")


@query(_period_sql("date_trunc('week', {})::DATE"), **TOKENS)
def usage_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_period(scoped(spark, sf_dir), contributions(spark, sf_dir), "week")


@query("SELECT sid, epoch_us(occurred_at) AS at, tokens, status, reason FROM ct", **TOKENS)
def usage_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).select("sid", F.unix_micros("occurred_at").alias("at"), F.col("usage.total_tokens").alias("tokens"), "status", "reason")


@query(
    """SELECT sum(observed)::BIGINT AS observed_tokens, coalesce(sum(baseline), 0)::BIGINT AS inherited_tokens, sum(accounted)::BIGINT AS reconciled_tokens, count(*) FILTER (lineage IN ('inherited_prefix', 'inherited_exact')) AS reconciled_children,
      count(*) FILTER (lineage = 'ambiguous') AS ambiguous_children, count(*) FILTER (lineage = 'cycle') AS cyclic_children, coalesce(sum(observed) FILTER (lineage = 'ambiguous'), 0)::BIGINT AS ambiguous_tokens FROM ac""",
    **TOKENS,
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.reconciliation(accounted_sessions(spark, sf_dir))


@query(
    """SELECT count(*) FILTER (status = 'complete') AS complete_sessions, count(*) FILTER (status = 'partial') AS partial_sessions, count(*) FILTER (status = 'fallback') AS fallback_sessions, coalesce(sum(timed), 0)::DOUBLE / sum(t)::DOUBLE AS attributed_fraction
      FROM (SELECT sid, status, sum(tokens) AS t, sum(tokens) FILTER (occurred_at IS NOT NULL) AS timed FROM ct GROUP BY sid, status)""",
    **TOKENS,
)
def temporal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.temporal_coverage(contributions(spark, sf_dir))


# events have no stable ids in the views; the longest runs of all families, then of each
EVENTS = {
    **{k: TOKENS[k] for k in ("e1", "up", "cyc")},
    "m": "SELECT sid, source_ordinal, family, family || '|' || fingerprint AS key, row_number() OVER (PARTITION BY sid ORDER BY source_ordinal) - 1 AS i, row_number() OVER (PARTITION BY sid, family ORDER BY source_ordinal) - 1 AS k FROM fx_messages",
    "ee": "SELECT * FROM e1 WHERE child NOT IN (SELECT node FROM cyc) AND parent NOT IN (SELECT node FROM cyc)",
    "ws": "SELECT e.parent, e.child, p.i AS s FROM ee e JOIN m p ON p.sid = e.parent JOIN m c ON c.sid = e.child AND c.i = 0 AND c.key = p.key",
    "wd": "SELECT ws.*, c.i, row_number() OVER (PARTITION BY ws.parent, ws.child, s ORDER BY c.i) - 1 AS r FROM ws JOIN m c ON c.sid = ws.child JOIN m p ON p.sid = ws.parent AND p.i = s + c.i AND p.key = c.key",
    "wb": "SELECT parent, child, arg_max(s, n * 1000000 - s) AS s, max(n) AS n FROM (SELECT parent, child, s, count(*) AS n FROM wd WHERE r = i GROUP BY ALL) GROUP BY parent, child HAVING max(n) >= 2",
    "fs": "SELECT e.parent, e.child, c.family, p.k AS s FROM ee e JOIN m p ON p.sid = e.parent JOIN m c ON c.sid = e.child AND c.k = 0 AND c.key = p.key",
    "fd": "SELECT fs.*, c.k, row_number() OVER (PARTITION BY fs.parent, fs.child, fs.family, s ORDER BY c.k) - 1 AS r FROM fs JOIN m c ON c.sid = fs.child AND c.family = fs.family JOIN m p ON p.sid = fs.parent AND p.family = fs.family AND p.k = s + c.k AND p.key = c.key",
    "fb": "SELECT parent, child, family, arg_max(s, n * 1000000 - s) AS s, max(n) AS n FROM (SELECT parent, child, family, s, count(*) AS n FROM fd WHERE r = k GROUP BY ALL) GROUP BY parent, child, family HAVING max(n) >= 2",
    "ev": """
      SELECT e.parent, e.child, c.i, c.family, c.source_ordinal, CASE WHEN e.child IN (SELECT node FROM cyc) OR e.parent IN (SELECT node FROM cyc) THEN 'ambiguous' WHEN e.parent NOT IN (SELECT sid FROM m) THEN 'unknown'
        WHEN c.i < wb.n THEN 'inherited_prefix' WHEN c.k < fb.n THEN 'inherited_prefix' WHEN x.key IS NOT NULL THEN 'ambiguous' ELSE 'origin' END AS status,
        CASE WHEN e.child IN (SELECT node FROM cyc) OR e.parent IN (SELECT node FROM cyc) THEN NULL WHEN c.i < wb.n THEN wb.s + c.i WHEN c.k < fb.n THEN p.i END AS parent_index
      FROM e1 e JOIN m c ON c.sid = e.child LEFT JOIN wb ON wb.parent = e.parent AND wb.child = e.child LEFT JOIN fb ON fb.parent = e.parent AND fb.child = e.child AND fb.family = c.family
      LEFT JOIN m p ON p.sid = e.parent AND p.family = c.family AND p.k = fb.s + c.k LEFT JOIN (SELECT DISTINCT sid, key FROM m) x ON x.sid = e.parent AND x.key = c.key""",
    "og": "SELECT m.sid, m.i, coalesce(ev.status, CASE WHEN m.sid IN (SELECT child FROM fx_edges) THEN 'unknown' ELSE 'origin' END) AS status, CASE WHEN ev.status = 'inherited_prefix' THEN ev.parent END AS up, ev.parent_index AS ui FROM m LEFT JOIN ev ON ev.child = m.sid AND ev.i = m.i",
    "tr": "SELECT sid, i, status, sid AS ts, i AS ti, status AS t FROM og UNION ALL SELECT tr.sid, tr.i, tr.status, a.up, a.ui, b.status FROM tr JOIN og a ON a.sid = tr.ts AND a.i = tr.ti JOIN og b ON b.sid = a.up AND b.i = a.ui",
}
FAMILY = "count(*) AS observed, count(*) FILTER (status = 'origin') AS originated, count(*) FILTER (status LIKE 'inherited%') AS inherited, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unknown') AS unknown"


@stored
def event_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.event_verdicts(X.messages(spark, sf_dir), X.edges(spark, sf_dir), thread_ancestry(spark, sf_dir))


@stored
def resolved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.origins(X.messages(spark, sf_dir), event_verdicts(spark, sf_dir), X.edges(spark, sf_dir))


@query("SELECT parent, child, i, family, source_ordinal, status, parent_index FROM ev", **EVENTS)
def event_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_verdicts(spark, sf_dir).drop("evidence")


@query(f"SELECT parent, child, family, {FAMILY}, CASE WHEN count(*) FILTER (status LIKE 'inherited%') > 0 THEN 'inherited_prefix' WHEN count(*) FILTER (status = 'ambiguous') > 0 THEN 'ambiguous' WHEN count(*) FILTER (status = 'unknown') > 0 THEN 'unknown' ELSE 'origin' END AS status FROM ev GROUP BY parent, child, family", **EVENTS)
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.replay_summary(event_verdicts(spark, sf_dir))


@query(f"SELECT family, {FAMILY}, count(DISTINCT child) FILTER (status LIKE 'inherited%') AS replaying_children FROM ev GROUP BY family", **EVENTS)
def provenance_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.by_family(event_verdicts(spark, sf_dir))


@query(
    """SELECT sid, i, CASE WHEN status LIKE 'inherited%' AND t IN ('ambiguous', 'unknown') THEN 'ambiguous' ELSE status END AS status,
      CASE WHEN (status LIKE 'inherited%' AND t NOT IN ('ambiguous', 'unknown')) OR status = 'origin' THEN ts END AS origin_sid, CASE WHEN (status LIKE 'inherited%' AND t NOT IN ('ambiguous', 'unknown')) OR status = 'origin' THEN ti END AS origin_i
    FROM tr JOIN og o ON o.sid = ts AND o.i = ti WHERE o.up IS NULL""".replace("SELECT sid, i,", "SELECT tr.sid, tr.i,").replace("WHEN status LIKE", "WHEN tr.status LIKE").replace("ELSE status", "ELSE tr.status").replace("(status LIKE", "(tr.status LIKE").replace("OR status =", "OR tr.status ="),
    **EVENTS,
)
def event_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_events(spark, sf_dir)
