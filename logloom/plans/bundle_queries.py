"""Reports of tasks, outcomes, tools and provenance, and the bundles of a period and a dashboard."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import params
from logloom.functions import prompts as P
from logloom.operators import provenance, reports, sessions, tools, usage

from . import commands as lines
from . import views as X
from .more_queries import COMMITS, OUTCOMES, TASKS, judged, linked, session_task_rows
from .queries import EVENTS, TOKENS, accounted_sessions, contributions, event_verdicts, query
from .report_queries import FULL, PROMPTS, SESSION_ROWS, full, full_scoped, prompt_facts, session_facts, tool_rows
from .stored import stored

#: Features of prompts that reports compare.
COMPARED = {"structured_headings": "headings", "acceptance_criteria": "has_acceptance_criteria", "validation_request": "requests_validation", "path_references": "paths", "commit_request": "requests_commit", "multiple_commit_request": "requests_multiple_commits", "explicit_non_goals": "has_non_goals", "read_only_constraint": "has_read_only_constraint"}
CHECKED = ("acceptance_criteria", "validation_request", "multiple_commit_request", "explicit_non_goals", "read_only_constraint")


@stored
def prompt_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the logical prompts."""
    rows = prompt_facts(spark, sf_dir).select("prompt_id", "sid", P.features(F.col("text")).alias("f"))
    return rows.select("prompt_id", "sid", "f.*")


@stored
def task_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per session: task, usage, commands, commits, prompts and their features, outcome."""
    acts = X.activity(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("activity"))
    commits = linked(spark, sf_dir).where("tier = 'high'").groupBy("sid").agg(F.count("*").alias("commits"))
    flags = [F.max(F.when(F.col(c) > 0, True).otherwise(False) if c in ("headings", "paths") else F.col(c)).alias(k) for k, c in COMPARED.items()]
    asked = prompt_feature_rows(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("prompts"), F.count("*").alias("feature_prompts"), *flags)
    known = accounted_sessions(spark, sf_dir).select("sid", F.col("accounted.total_tokens").alias("tokens"), F.col("observed.total_tokens").alias("observed"))
    kinds = session_task_rows(spark, sf_dir).select("sid", "action", "domain", "confidence", "evidence")
    rows = full(spark, sf_dir).select("sid", "repository_root", "client_kind")
    for t in (kinds, known, acts, commits, asked, judged(spark, sf_dir).select("sid", "outcome")):
        rows = rows.join(t, "sid", "left")
    rows = rows.fillna("unknown", ["action", "domain", "outcome"]).fillna("low", ["confidence"]).fillna(0, ["activity", "commits", "prompts", "feature_prompts"])
    return rows.withColumn("commands", F.col("activity"))


def _features_sql() -> str:
    """Of the logical prompts: features that both engines' patterns can tell."""
    q = {k: v.replace("'", "''") for k, v in P.FEATURES.items()}
    n = lambda t, k: f"len(regexp_extract_all({t}, '{q[k]}')) > 0"
    positive = f"array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l, '{q['non_goal']}')), chr(10))"
    return f"""SELECT sid, count(*) AS prompts, bool_or({n('t', 'acceptance')}) AS acceptance_criteria, bool_or({n('p', 'validation')}) AS validation_request, bool_or({n('p', 'commits')}) AS multiple_commit_request, bool_or({n('t', 'non_goal')}) AS explicit_non_goals, bool_or({n('t', 'read_only')}) AS read_only_constraint
      FROM (SELECT *, {positive} AS p FROM (SELECT sid, regexp_replace(regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g'), '\\r\\n?', chr(10), 'g') AS t FROM pi)) GROUP BY sid"""


FACTS = PROMPTS | TOKENS | TASKS | OUTCOMES | {
    "pf": _features_sql(),
    "tf_": """SELECT fu.sid, fu.repository_root, fu.client_kind, coalesce(action, 'unknown') AS action, coalesce(domain, 'unknown') AS domain, coalesce(by_prompt, false) AS by_prompt, ac.accounted AS tokens, ac.observed, coalesce(a.n, 0) AS activity, coalesce(h.n, 0) AS commits, coalesce(pf.prompts, 0) AS prompts, coalesce(outcome, 'unknown') AS outcome, pf.* EXCLUDE (sid, prompts)
      FROM fu LEFT JOIN tk USING (sid) LEFT JOIN ac USING (sid) LEFT JOIN (SELECT sid, count(*) AS n FROM fx_activity GROUP BY sid) a USING (sid) LEFT JOIN (SELECT sid, count(*) AS n FROM tl WHERE r = 3 GROUP BY sid) h USING (sid) LEFT JOIN pf USING (sid) LEFT JOIN oc USING (sid)""",
}


@query(
    """SELECT action, count(*) AS sessions, count(*) FILTER (action = 'unknown') AS unknown_tasks, sum(tokens)::BIGINT AS tokens, count(tokens) AS known_sessions, median(observed) AS observed_median, quantile_cont(observed, 0.9) AS observed_p90, sum(activity)::BIGINT AS commands, sum(commits)::BIGINT AS commits, sum(prompts)::BIGINT AS prompts,
      count(*) FILTER (prompts > 0) AS sessions_with_features, sum(prompts)::BIGINT AS prompts_with_features, (SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) FROM (SELECT action, outcome, count(*) AS n FROM tf_ GROUP BY ALL) x WHERE x.action = tf_.action) AS outcomes FROM tf_ GROUP BY action""",
    **FACTS,
)
def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by action (confidences are checked by tests of the operator)."""
    return reports.task_metrics(task_facts(spark, sf_dir), "action").drop("confidences")


@query(
    """SELECT repository_root, domain, count(*) AS sessions, count(*) FILTER (action = 'unknown') AS unknown_tasks, sum(tokens)::BIGINT AS tokens, count(tokens) AS known_sessions, median(observed) AS observed_median, quantile_cont(observed, 0.9) AS observed_p90, sum(activity)::BIGINT AS commands, sum(commits)::BIGINT AS commits, sum(prompts)::BIGINT AS prompts,
      count(*) FILTER (prompts > 0) AS sessions_with_features, sum(prompts)::BIGINT AS prompts_with_features FROM tf_ GROUP BY repository_root, domain""",
    **FACTS,
)
def task_metrics_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.task_metrics(task_facts(spark, sf_dir), "repository_root", "domain").drop("confidences", "outcomes")


@query(
    """SELECT repository_root, count(*) FILTER (prompts > 0) AS prompt_backed, count(*) FILTER (prompts = 0 AND (activity > 0 OR commits > 0)) AS originated_activity_only, 0 AS fallback_only, count(*) FILTER (prompts = 0 AND activity = 0 AND commits = 0) AS no_origin_evidence, count(*) FILTER (client_kind = 'subagent') AS subagent_sessions,
      count(*) FILTER (prompts = 0 AND action = 'unknown' AND domain = 'unknown') AS both_unknown_without_prompt, count(*) FILTER (prompts > 0 AND (action = 'unknown' OR domain = 'unknown')) AS prompt_backed_unknown FROM tf_ GROUP BY repository_root""",
    **FACTS,
)
def task_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.task_evidence(task_facts(spark, sf_dir), "repository_root")


def _comparison_sql() -> str:
    parts = []
    for f in CHECKED:
        side = lambda v, f=f: f"(SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) FROM (SELECT outcome, count(*) AS n FROM tf_ WHERE prompts > 0 AND {f} = {v} GROUP BY outcome))"
        parts.append(f"SELECT '{f}' AS feature, count(*) FILTER ({f}) AS with_n, count(*) FILTER (NOT {f}) AS without_n, {side('true')} AS on_, {side('false')} AS off_ FROM tf_ WHERE prompts > 0")
    ok = "with_n >= 5 AND without_n >= 5"
    return f"SELECT feature, {ok} AS eligible, with_n, without_n, CASE WHEN {ok} THEN on_ END AS with_outcomes, CASE WHEN {ok} THEN off_ END AS without_outcomes FROM (" + " UNION ALL ".join(parts) + ")"


@query(_comparison_sql(), **FACTS)
def feature_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of sessions with and without a feature of their prompts."""
    return reports.feature_outcomes(task_facts(spark, sf_dir), list(CHECKED))


@query(
    """SELECT outcome, count(*) AS sessions, CASE WHEN outcome <> 'unknown' THEN count(*) / (SELECT count(*) FROM sl WHERE outcome <> 'unknown')::DOUBLE END AS fraction, count(*) FILTER (outcome <> 'unknown' AND outcome_confidence IN ('high', 'medium')) AS strong,
      CASE WHEN outcome <> 'unknown' THEN count(*) FILTER (outcome_confidence IN ('high', 'medium')) / (SELECT count(*) FROM sl WHERE outcome <> 'unknown' AND outcome_confidence IN ('high', 'medium'))::DOUBLE END AS strong_fraction FROM sl GROUP BY outcome""",
    **SESSION_ROWS,
)
def outcome_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcome_fractions(session_facts(spark, sf_dir).select("outcome", F.col("outcome_confidence").alias("confidence")))


# ---- tools and provenance

@query(
    "SELECT coalesce(repository_root, 'outside-git') AS repository, coalesce(model, 'unknown') AS model, command_category, count(*) AS commands FROM cm JOIN fu USING (sid) GROUP BY ALL ORDER BY commands DESC, 1, 2, 3",
    **FULL,
    cm=lines.SQL,
)
def originated_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands by repository, model and category, the most frequent first."""
    rows = tool_rows(spark, sf_dir).join(full(spark, sf_dir).select("sid", "repository_root", "model"), "sid")
    return rows.groupBy(F.coalesce("repository_root", F.lit("outside-git")).alias("repository"), F.coalesce("model", F.lit("unknown")).alias("model"), "command_category").agg(F.count("*").alias("commands")).orderBy(F.desc("commands"), "repository", "model", "command_category")


@query("SELECT executable, count(*) AS calls FROM cm WHERE executable IS NOT NULL AND command_category IN ('testing', 'linting', 'type_checking') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", cm=lines.SQL)
def top_checkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executables of most checks."""
    return tools.top(tools.of(tool_rows(spark, sf_dir), categories=["testing", "linting", "type_checking"], commands_only=True), "executable", 5)


@query("SELECT sid, count(*) AS calls, count(*) FILTER (result_status = 'failure') AS failures, string_agg(command_category || '=' || n, ',' ORDER BY command_category) FILTER (k = 1) AS categories FROM (SELECT *, count(*) OVER (PARTITION BY sid, command_category) AS n, row_number() OVER (PARTITION BY sid, command_category ORDER BY event_id) AS k FROM fx_activity) GROUP BY sid")
def session_tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.per_session(X.activity(spark, sf_dir))
    return rows.withColumn("categories", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


#: Every event with its verdict before origins are followed.
ALL_EVENTS = EVENTS | {"av": "SELECT m.sid, m.family, og.status FROM m JOIN og USING (sid, i)"}


@query(
    """SELECT (SELECT count(*) FROM fx_edges) AS edges, (SELECT count(DISTINCT child) FROM fx_edges) AS children, count(*) AS observed, count(*) FILTER (status = 'origin') AS originated, count(*) FILTER (status LIKE 'inherited%') AS inherited, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unknown') AS unknown,
      count(DISTINCT sid) FILTER (status LIKE 'inherited%') AS sessions_with_replay, count(DISTINCT family) FILTER (status LIKE 'inherited%') AS families_affected FROM av""",
    **ALL_EVENTS,
)
def provenance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_states(spark, sf_dir)
    s = F.col("status")
    inherited = s.isin("inherited_prefix", "inherited_exact")
    e = X.edges(spark, sf_dir).agg(F.count("*").alias("edges"), F.count_distinct("child").alias("children"))
    return e.crossJoin(rows.agg(F.count("*").alias("observed"), F.count_if(s == "origin").alias("originated"), F.count_if(inherited).alias("inherited"), F.count_if(s == "ambiguous").alias("ambiguous"), F.count_if(s == "unknown").alias("unknown"), F.count_distinct(F.when(inherited, F.col("sid"))).alias("sessions_with_replay"), F.count_distinct(F.when(inherited, F.col("family"))).alias("families_affected")))  # one row each


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: verdicts of children, origin for the rest, unknown for children without a verdict."""
    order = W.partitionBy("sid").orderBy("source_ordinal")
    every = X.messages(spark, sf_dir).select("sid", "family", (F.row_number().over(order) - 1).alias("i"))
    v = event_verdicts(spark, sf_dir).select(F.col("child").alias("sid"), "i", "status")
    spawned = X.edges(spark, sf_dir).select(F.col("child").alias("sid"), F.lit("unknown").alias("none")).distinct()
    return every.join(v, ["sid", "i"], "left").join(spawned, "sid", "left").select("sid", "family", F.coalesce("status", "none", F.lit("origin")).alias("status"))


@query("SELECT family, count(*) FILTER (inherited > 0) AS replay, count(*) FILTER (inherited = 0 AND ambiguous > 0) AS ambiguous, count(*) FILTER (inherited = 0 AND ambiguous = 0) AS none FROM (SELECT parent, child, family, count(*) FILTER (status LIKE 'inherited%') AS inherited, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM ev GROUP BY ALL) GROUP BY family", **EVENTS)
def replay_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by whether their child replays a family."""
    rows = provenance.replay_summary(event_verdicts(spark, sf_dir))
    some, unsure = F.col("inherited") > 0, F.col("ambiguous") > 0
    return rows.groupBy("family").agg(F.count_if(some).alias("replay"), F.count_if(~some & unsure).alias("ambiguous"), F.count_if(~some & ~unsure).alias("none"))


@query("SELECT sid, category, count(*) AS n FROM (SELECT sid, CASE family WHEN 'user_message' THEN 'user' WHEN 'assistant_message' THEN 'assistant' ELSE 'other' END AS category FROM fx_messages) GROUP BY ALL")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("family") == "user_message", "user").when(F.col("family") == "assistant_message", "assistant").otherwise("other")
    return X.messages(spark, sf_dir).groupBy("sid", kind.alias("category")).agg(F.count("*").alias("n"))


# ---- bundles

ZONE = params.zone("UTC")
START, END = params.period("week", date(2024, 1, 3), ZONE)
NEXT = params.period("week", date(2024, 1, 10), ZONE)
BEFORE = params.period_before("week", NEXT[0], ZONE)


def span(a: datetime | None, z: datetime | None, c: str) -> str:
    """The window as SQL."""
    stamp = lambda t: f"TIMESTAMP '{t.astimezone(UTC):%Y-%m-%d %H:%M:%S}'"
    return " AND ".join([f"{c} IS NOT NULL", *([f"{c} >= {stamp(a)}"] if a else []), *([f"{c} < {stamp(z)}"] if z else [])])


def overview(spark: SparkSession, sf_dir: str, since: datetime | None, until: datetime | None) -> DataFrame:
    """One row of a window: sessions, active days, tokens, commands, commits, and how many sessions tell tokens; each on its own clock."""
    rows, parts = usage.windowed(full_scoped(spark, sf_dir), contributions(spark, sf_dir), since, until)
    inside = sessions.in_window
    days = rows.select(F.to_date("started_at").alias("d")).union(parts.select(F.to_date("occurred_at"))).where("d IS NOT NULL").agg(F.count_distinct("d").alias("active_days"))
    used = rows.agg(F.count("*").alias("sessions"), F.count_distinct(F.coalesce("repository_root", F.lit(""))).alias("repositories"), F.sum("used.total_tokens").alias("reconciled_tokens"), F.count("used.total_tokens").alias("known_sessions"))
    acts = X.activity(spark, sf_dir).where(inside(F.col("occurred_at"), since, until)).agg(F.count("*").alias("commands"))
    commits = linked(spark, sf_dir).where("tier = 'high'").where(inside(F.col("committed_at"), since, until)).agg(F.count_distinct("commit_hash").alias("commits"))
    return used.crossJoin(days).crossJoin(acts).crossJoin(commits).withColumn("coverage", F.when(F.col("sessions") > 0, F.col("known_sessions") / F.col("sessions")))  # one row each


def _overview_sql(a: datetime | None, z: datetime | None) -> str:
    timed = span(a, z, "occurred_at") if a or z else "true"
    rows = f"SELECT fu.*, u.used FROM fu LEFT JOIN ac USING (sid) LEFT JOIN (SELECT sid, sum(tokens)::BIGINT AS used FROM ct WHERE {timed} GROUP BY sid) u USING (sid)" + (f" WHERE used IS NOT NULL OR ({span(a, z, 'started_at')})" if a or z else "")
    days = f"SELECT count(DISTINCT d) FROM (SELECT started_at::DATE AS d FROM ({rows}) UNION ALL SELECT occurred_at::DATE FROM ct WHERE occurred_at IS NOT NULL AND ({timed}) AND sid IN (SELECT sid FROM fx_sessions))"
    return f"""SELECT count(*) AS sessions, count(DISTINCT coalesce(repository_root, '')) AS repositories, sum(used)::BIGINT AS reconciled_tokens, count(used) AS known_sessions, ({days}) AS active_days, (SELECT count(*) FROM fx_activity WHERE {span(a, z, 'occurred_at')}) AS commands,
      (SELECT count(DISTINCT commit_hash) FROM tl WHERE r = 3 AND {span(a, z, 'committed_at')}) AS commits, count(used) / count(*)::DOUBLE AS coverage FROM ({rows})"""


BUNDLE = TOKENS | FULL | COMMITS


@query(_overview_sql(START, END), **BUNDLE)
def report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(spark, sf_dir, START, END)


METRICS = ("sessions", "active_days", "reconciled_tokens", "commands", "commits")


@query(
    f"SELECT metric, current, previous, current - previous AS change, CASE WHEN comparable AND previous <> 0 THEN (current - previous) / previous::DOUBLE END AS percentage_change, comparable FROM (SELECT unnest([{', '.join(repr(m) for m in METRICS)}]) AS metric, unnest([{', '.join('a.' + m for m in METRICS)}]) AS current, unnest([{', '.join('b.' + m for m in METRICS)}]) AS previous, abs(a.coverage - b.coverage) <= 0.1 AS comparable FROM ({_overview_sql(*NEXT)}) a, ({_overview_sql(*BEFORE)}) b)",
    **BUNDLE,
)
def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week against the one before."""
    return reports.changes(overview(spark, sf_dir, *NEXT), overview(spark, sf_dir, *BEFORE), list(METRICS), "coverage")


IN = span(START, END, "{}")
WEEK = FACTS | {
    "rw": f"SELECT fu.*, ac.observed, u.used FROM fu LEFT JOIN ac USING (sid) LEFT JOIN (SELECT sid, sum(tokens)::BIGINT AS used FROM ct WHERE {IN.replace('{}', 'occurred_at')} GROUP BY sid) u USING (sid) WHERE used IS NOT NULL OR ({IN.replace('{}', 'started_at')})",
    "rc": f"SELECT repository_root, model, count(*) AS n FROM fx_activity JOIN fu USING (sid) WHERE {IN.replace('{}', 'occurred_at')} GROUP BY ALL",
    "rh": f"SELECT repository_root, model, count(*) AS n FROM tl JOIN fu USING (sid) WHERE r = 3 AND {IN.replace('{}', 'committed_at')} GROUP BY ALL",
}


def in_week(df: DataFrame, c: str) -> DataFrame:
    return df.where(sessions.in_window(F.col(c), START, END))


def week_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return usage.windowed(full_scoped(spark, sf_dir), contributions(spark, sf_dir), START, END)


@query(
    f"""SELECT g.repository_root, sessions, tokens, coalesce(c.n, 0) AS commands, coalesce(h.n, 0) AS commits, oh.outcomes, coalesce(d.action, 'unknown') AS dominant_task
      FROM (SELECT repository_root, count(*) AS sessions, sum(used)::BIGINT AS tokens FROM rw GROUP BY 1) g
      LEFT JOIN (SELECT repository_root, sum(n)::BIGINT AS n FROM rc GROUP BY 1) c ON c.repository_root IS NOT DISTINCT FROM g.repository_root LEFT JOIN (SELECT repository_root, sum(n)::BIGINT AS n FROM rh GROUP BY 1) h ON h.repository_root IS NOT DISTINCT FROM g.repository_root
      LEFT JOIN (SELECT repository_root, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes FROM (SELECT repository_root, outcome, count(*) AS n FROM tf_ JOIN fx_sessions s USING (sid, repository_root) WHERE {IN.replace('{}', 's.started_at')} GROUP BY ALL UNION ALL SELECT NULL, outcome, count(*) FROM tf_ JOIN fx_sessions s USING (sid) WHERE s.repository_root IS NULL AND {IN.replace('{}', 's.started_at')} GROUP BY ALL) GROUP BY 1) oh ON oh.repository_root IS NOT DISTINCT FROM g.repository_root
      LEFT JOIN (SELECT repository_root, arg_min(action, (-n, action)) AS action FROM (SELECT s.repository_root, action, count(*) AS n FROM tf_ JOIN fx_sessions s USING (sid) WHERE {IN.replace('{}', 's.started_at')} GROUP BY ALL) GROUP BY 1) d ON d.repository_root IS NOT DISTINCT FROM g.repository_root""",
    **WEEK,
)
def report_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's repositories: usage, commands, linked commits, outcomes and the commonest task; joined by key."""
    rows, _ = week_rows(spark, sf_dir)
    names = full(spark, sf_dir).select("sid", "repository_root")
    g = rows.groupBy("repository_root").agg(F.count("*").alias("sessions"), F.sum("used.total_tokens").alias("tokens"))
    c = in_week(X.activity(spark, sf_dir), "occurred_at").join(names, "sid").groupBy("repository_root").agg(F.count("*").alias("commands"))
    h = in_week(linked(spark, sf_dir).where("tier = 'high'"), "committed_at").join(names, "sid").groupBy("repository_root").agg(F.count("*").alias("commits"))
    began = task_facts(spark, sf_dir).join(in_week(X.sessions(spark, sf_dir), "started_at").select("sid"), "sid", "left_semi")
    o = reports.histogram(began, ["repository_root"], "outcome", "outcomes")
    d = began.groupBy("repository_root", "action").agg(F.count("*").alias("n")).groupBy("repository_root").agg(F.min_by("action", F.struct(-F.col("n"), "action")).alias("dominant_task"))
    return reports.joined([g, c, h, o, d], ["repository_root"]).fillna(0, ["commands", "commits"]).fillna("unknown", ["dominant_task"])


@query(
    """SELECT g.model, g.provider, sessions, tokens, coalesce(c.n, 0) AS commands, coalesce(h.n, 0) AS commits FROM (SELECT model, provider, count(*) AS sessions, sum(used)::BIGINT AS tokens FROM rw GROUP BY ALL) g
      LEFT JOIN (SELECT model, sum(n)::BIGINT AS n FROM rc GROUP BY 1) c ON c.model IS NOT DISTINCT FROM g.model LEFT JOIN (SELECT model, sum(n)::BIGINT AS n FROM rh GROUP BY 1) h ON h.model IS NOT DISTINCT FROM g.model""",
    **WEEK,
)
def report_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's models; commands and commits by the model's name."""
    rows, _ = week_rows(spark, sf_dir)
    names = full(spark, sf_dir).select("sid", "model")
    g = rows.groupBy("model", "provider").agg(F.count("*").alias("sessions"), F.sum("used.total_tokens").alias("tokens"))
    c = in_week(X.activity(spark, sf_dir), "occurred_at").join(names, "sid").groupBy("model").agg(F.count("*").alias("commands"))
    h = in_week(linked(spark, sf_dir).where("tier = 'high'"), "committed_at").join(names, "sid").groupBy("model").agg(F.count("*").alias("commits"))
    return reports.joined([g, c, h], ["model"]).fillna(0, ["commands", "commits"])


@query(
    "SELECT arg_min(reason, k) AS reason, sid::VARCHAR AS session_id, any_value(started) AS started, any_value(repository) AS repository, any_value(model) AS model, any_value(total_tokens) AS total_tokens, any_value(seconds) AS seconds FROM nb JOIN nw USING (sid) GROUP BY sid",
    **SESSION_ROWS,
    nw=f"SELECT sl.* FROM sl JOIN fx_sessions s USING (sid) WHERE {IN.replace('{}', 's.started_at')}",
    nb="SELECT 'highest_observed_rollout_total' AS reason, 0 AS k, arg_max(sid, (total_tokens, sid::VARCHAR)) AS sid FROM nw WHERE total_tokens IS NOT NULL UNION ALL SELECT 'longest_session', 1, arg_max(sid, (seconds, sid::VARCHAR)) FROM nw WHERE seconds IS NOT NULL",
)
def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's sessions worth a note."""
    began = in_week(X.sessions(spark, sf_dir), "started_at").select("sid")
    rows = session_facts(spark, sf_dir).join(began, "sid", "left_semi")
    return reports.notes(rows.select(F.col("sid").cast("string").alias("id"), "started", "repository", "model", "total_tokens", "seconds"))


@query(
    """SELECT count(*) AS sessions, count(observed) AS known_sessions, count(*) FILTER (lineage <> 'root') AS child_threads, count(*) FILTER (lineage IN ('ambiguous', 'cycle')) AS ambiguous_threads, (SELECT count(*) FILTER (status = 'origin') / count(*)::DOUBLE FROM av) AS originated_fraction, (SELECT count(*) FROM pi) AS prompts,
      (SELECT count(DISTINCT sid) FROM pi) AS prompt_sessions, (SELECT count(DISTINCT commit_hash) FROM tl WHERE r = 3) AS commits, (SELECT count(DISTINCT sid) FROM tl WHERE r = 3) AS commit_sessions, (SELECT count(*) FROM tf_ WHERE outcome = 'unknown') AS unknown_outcomes, (SELECT count(*) FROM tf_ WHERE action = 'unknown') AS unknown_tasks FROM fu LEFT JOIN ac USING (sid)""",
    **(FACTS | ALL_EVENTS),
)
def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the data can be trusted."""
    used = full_scoped(spark, sf_dir).agg(F.count("*").alias("sessions"), F.count("observed.total_tokens").alias("known_sessions"), F.count_if(F.col("lineage") != "root").alias("child_threads"), F.count_if(F.col("lineage").isin("ambiguous", "cycle")).alias("ambiguous_threads"))
    seen = event_states(spark, sf_dir).agg((F.count_if(F.col("status") == "origin") / F.count("*")).alias("originated_fraction"))
    asked = prompt_feature_rows(spark, sf_dir).agg(F.count("*").alias("prompts"), F.count_distinct("sid").alias("prompt_sessions"))
    made = linked(spark, sf_dir).where("tier = 'high'").agg(F.count_distinct("commit_hash").alias("commits"), F.count_distinct("sid").alias("commit_sessions"))
    left = task_facts(spark, sf_dir).agg(F.count_if(F.col("outcome") == "unknown").alias("unknown_outcomes"), F.count_if(F.col("action") == "unknown").alias("unknown_tasks"))
    return used.crossJoin(seen).crossJoin(asked).crossJoin(made).crossJoin(left)  # one row each


NOW = datetime(2024, 1, 10, 15, tzinfo=UTC)
WINDOWS = params.local_windows(NOW, params.zone("America/New_York"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"window\", * FROM ({_overview_sql(a, z)})" for k, (a, z) in WINDOWS.items()), **BUNDLE)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today, this week and all time, as a zone has them."""
    out = None
    for k, (a, z) in WINDOWS.items():
        row = overview(spark, sf_dir, a, z).select(F.lit(k).alias("window"), "*")
        out = row if out is None else out.unionByName(row)
    return out
