"""Windows, session rows, exports and report tables over the stored facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import params
from logloom.functions import prompts as P
from logloom.operators import prompts, sessions, usage
from logloom.sources import exports

from . import commands as lines
from . import views as X
from .more_queries import COMMITS, OUTCOMES, RESOLVED, TASKS, judged, linked, session_task_rows, tool_rows
from .queries import EVENTS, TOKENS, accounted_sessions, contributions, observed, query, resolved_events

ZONE = params.zone("America/New_York")
SINCE, UNTIL = params.time_range("2024-01-01", "2024-01-10", where=ZONE)
IN = "{0} >= TIMESTAMP '2024-01-01 05:00:00' AND {0} < TIMESTAMP '2024-01-11 05:00:00'"

#: Sessions with all that a catalogue tells.
FULL = {
    "fu": """SELECT *, CASE WHEN model IS NOT NULL THEN 'provider-' || (sid % 2) END AS provider, CASE WHEN sid % 3 <> 0 AND repository_root IS NOT NULL THEN 'Repo-' || (sid % 8) END AS repository_name, sid % 6 = 0 AS archived,
      coalesce(CASE WHEN sid % 3 <> 0 AND repository_root IS NOT NULL THEN 'Repo-' || (sid % 8) END, split_part(repository_root, '/', 3), 'Outside Git repositories') AS repository FROM fx_sessions""",
}


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sid = X.sessions(spark, sf_dir), F.col("sid")
    name = F.when((sid % 3 != 0) & F.col("repository_root").isNotNull(), F.concat(F.lit("Repo-"), sid % 8))
    return s.select("*", F.when(F.col("model").isNotNull(), F.concat(F.lit("provider-"), sid % 2)).alias("provider"), name.alias("repository_name"), (sid % 6 == 0).alias("archived"), sessions.label(F.col("repository_root"), name).alias("repository"))


def full_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).join(accounted_sessions(spark, sf_dir), "sid", "left")


def window(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, parts = usage.windowed(full_scoped(spark, sf_dir), contributions(spark, sf_dir), SINCE, UNTIL)
    return rows, parts, usage.scope(rows, parts, ZONE, SINCE, UNTIL)


# what sessions used in the window, and the sessions that count
WINDOW = TOKENS | FULL | {
    "wc": f"SELECT * FROM ct WHERE occurred_at IS NOT NULL AND {IN.format('occurred_at')} AND sid IN (SELECT sid FROM fx_sessions)",
    "wr": f"SELECT fu.*, ac.observed, ac.lineage, u.used FROM fu LEFT JOIN ac USING (sid) LEFT JOIN (SELECT sid, sum(tokens)::BIGINT AS used FROM wc GROUP BY sid) u USING (sid) WHERE used IS NOT NULL OR {IN.format('started_at')}",
}
FIELDS = "count(*) AS sessions, NULL::BIGINT AS input_tokens, NULL::BIGINT AS cached_input_tokens, NULL::BIGINT AS output_tokens, NULL::BIGINT AS reasoning_output_tokens, sum(used)::BIGINT AS total_tokens, count(used) AS known_sessions, sum(observed)::BIGINT AS observed_tokens, avg(observed) AS mean_tokens, median(observed) AS median_tokens, quantile_disc(observed, 0.9) AS p90_tokens, count(*) / 10::DOUBLE AS sessions_per_day"


@query(f"SELECT repository_root, {FIELDS} FROM wr GROUP BY repository_root ORDER BY total_tokens DESC NULLS LAST, sessions DESC, lower(coalesce(split_part(repository_root, '/', 3), 'Outside Git repositories')), repository_root LIMIT 5", **WINDOW)
def usage_window_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five repositories of most tokens in a window of local days."""
    rows, _, days = window(spark, sf_dir)
    return usage.ranked(usage.window_metrics(rows, days, "repository_root"), sessions.label(F.col("repository_root")), "repository_root", top=5)


@query(f"SELECT model, provider, {FIELDS} FROM wr GROUP BY model, provider", **WINDOW)
def usage_window_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, days = window(spark, sf_dir)
    return usage.ranked(usage.window_metrics(rows, days, "model", "provider"), F.coalesce("model", F.lit("Unknown model")), "model", "provider")


@query(f"SELECT {FIELDS} FROM wr", **WINDOW)
def usage_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, days = window(spark, sf_dir)
    return usage.window_metrics(rows, days)


def _local(c: str) -> str:
    return f"({c} - INTERVAL 5 HOUR)::DATE"


# a period before the scope has no days in it
NONE_BEFORE = ("coalesce(n, 0) / (date_diff", "coalesce(n, 0) / (CASE WHEN p < DATE '2024-01-01' THEN NULL ELSE 1 END * date_diff")


def _window_periods_sql(p: str, width: int) -> str:
    start, event = p.format(_local("started_at")), p.format(_local("occurred_at"))
    return f"""SELECT strftime(p, '%Y-%m-%d') AS period, coalesce(n, 0) AS sessions, tokens, coalesce(k, 0) AS contributing_sessions, mean_tokens, median_tokens,
      coalesce(n, 0) / (date_diff('day', greatest(p, DATE '2024-01-01'), least(p + {width - 1}, DATE '2024-01-10')) + 1)::DOUBLE AS sessions_per_day
      FROM (SELECT {start}::DATE AS p, count(*) AS n, avg(observed) AS mean_tokens, median(observed) AS median_tokens FROM wr GROUP BY 1) FULL JOIN (SELECT {event}::DATE AS p, sum(tokens)::BIGINT AS tokens, count(DISTINCT sid) AS k FROM wc GROUP BY 1) USING (p)"""


@query(_window_periods_sql("{}", 1).replace(*NONE_BEFORE), **WINDOW)
def usage_window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts, days = window(spark, sf_dir)
    return usage.window_periods(rows, parts, days, "day", ZONE)


@query(_window_periods_sql("date_trunc('week', {})", 7).replace(*NONE_BEFORE).replace("p < DATE", "p + 6 < DATE"), **WINDOW)
def usage_window_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts, days = window(spark, sf_dir)
    return usage.window_periods(rows, parts, days, "week", ZONE)


@query(
    """SELECT sum(observed)::BIGINT AS observed_tokens, coalesce(sum(baseline), 0)::BIGINT AS inherited_tokens, sum(accounted)::BIGINT AS reconciled_tokens, count(*) FILTER (lineage = 'root') AS root_threads, count(*) FILTER (lineage <> 'root') AS child_threads,
      count(*) FILTER (lineage LIKE 'inherited%') AS reconciled_children, count(*) FILTER (lineage = 'independent') AS independent_children, count(*) FILTER (lineage = 'ambiguous') AS ambiguous_children, count(*) FILTER (lineage = 'unavailable') AS unavailable_children, count(*) FILTER (lineage = 'cycle') AS cycle_children,
      coalesce(sum(observed) FILTER (lineage IN ('ambiguous', 'cycle')), 0)::BIGINT AS ambiguous_tokens, count(*) FILTER (lineage LIKE 'inherited%' OR lineage = 'independent') / count(*) FILTER (lineage <> 'root')::DOUBLE AS child_coverage,
      (SELECT count(*) FROM fx_edges WHERE parent NOT IN (SELECT sid FROM fx_sessions) OR child NOT IN (SELECT sid FROM fx_sessions)) AS orphan_edges FROM ac""",
    **TOKENS,
)
def child_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.child_states(accounted_sessions(spark, sf_dir), X.edges(spark, sf_dir), X.sessions(spark, sf_dir))


@query(
    """SELECT count(*) FILTER (status = 'complete') AS complete_sessions, 0 AS partial_sessions, count(*) FILTER (status = 'fallback') AS fallback_sessions, count(*) FILTER (status IS NULL) AS unavailable_sessions, coalesce(sum(timed), 0)::BIGINT AS attributed_tokens, coalesce(sum(untimed), 0)::BIGINT AS unattributed_tokens,
      (SELECT coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason), '') FROM (SELECT reason, count(DISTINCT sid) AS n FROM ct WHERE reason IS NOT NULL GROUP BY reason)) AS reasons, coalesce(sum(timed), 0)::DOUBLE / (coalesce(sum(timed), 0) + coalesce(sum(untimed), 0)) AS attributed_fraction
      FROM ac LEFT JOIN (SELECT sid, any_value(status) AS status, sum(tokens) FILTER (occurred_at IS NOT NULL) AS timed, sum(tokens) FILTER (occurred_at IS NULL) AS untimed FROM ct GROUP BY sid) USING (sid)""",
    **TOKENS,
)
def attribution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = usage.attribution_coverage(contributions(spark, sf_dir), accounted_sessions(spark, sf_dir))
    return row.withColumn("reasons", F.coalesce(F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","), F.lit("")))


# ---- session rows

SESSION_ROWS = TOKENS | FULL | TASKS | OUTCOMES | {
    "mn": "SELECT sid, count(*) AS events FROM fx_messages GROUP BY sid",
    "sl": """SELECT fu.sid, epoch_us(started_at) AS started, epoch_us(ended_at) AS ended, CASE WHEN ended_at >= started_at THEN epoch(ended_at)::BIGINT - epoch(started_at)::BIGINT END AS seconds, client_kind, archived, repository, repository_root, model, provider,
      o.observed AS total_tokens, events, coalesce(oc.outcome, 'unknown') AS outcome, coalesce(oc.confidence, 'low') AS outcome_confidence, coalesce(oc.lifecycle, 'unknown') AS lifecycle, coalesce(tk.action, 'unknown') AS action, coalesce(tk.domain, 'unknown') AS domain
      FROM fu LEFT JOIN o USING (sid) LEFT JOIN mn USING (sid) LEFT JOIN oc USING (sid) LEFT JOIN tk USING (sid)""",
}


def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with usage, events, outcome and task."""
    counts = X.messages(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("events"))
    rows = full(spark, sf_dir).join(observed(spark, sf_dir).select("sid", F.col("observed.total_tokens").alias("total_tokens")), "sid", "left").join(counts, "sid", "left")
    rows = rows.join(judged(spark, sf_dir).select("sid", F.col("outcome").alias("o"), F.col("confidence").alias("oc"), F.col("lifecycle").alias("l")), "sid", "left").join(session_task_rows(spark, sf_dir).select("sid", F.col("action").alias("a"), F.col("domain").alias("d")), "sid", "left")
    known = lambda c, d: F.coalesce(c, F.lit(d))
    return rows.select("sid", F.unix_micros("started_at").alias("started"), F.unix_micros("ended_at").alias("ended"), sessions.duration(F.col("started_at"), F.col("ended_at")).alias("seconds"), "client_kind", "archived", "repository", "repository_root", "model", "provider", "total_tokens", "events", known("o", "unknown").alias("outcome"), known("oc", "low").alias("outcome_confidence"), known("l", "unknown").alias("lifecycle"), known("a", "unknown").alias("action"), known("d", "unknown").alias("domain"))


@query("SELECT * FROM sl WHERE (lower(repository) = 'repo-1' OR repository_root = '/repos/repo-1' OR repository_root IS NULL) AND lower(model) = 'model-1' AND NOT archived AND client_kind <> 'subagent' ORDER BY started DESC NULLS LAST, sid LIMIT 100", **SESSION_ROWS)
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered by repository (name in any case, root, or none), model, client and archive flag; newest first."""
    rows = session_facts(spark, sf_dir)
    root, name = F.col("repository_root"), F.col("repository")
    rows = rows.where((sessions.of_repository("REPO-1", root, name) | sessions.of_repository("/repos/repo-1", root, name) | sessions.of_repository("non-git", root)) & sessions.of_model("Model-1", F.col("model")) & ~F.col("archived") & (F.col("client_kind") != "subagent"))
    return rows.orderBy(F.desc_nulls_last("started"), "sid").limit(100)


@query("SELECT * FROM sl WHERE coalesce(action, 'unknown') = 'testing' AND outcome = 'failed' AND outcome_confidence = 'high'", **SESSION_ROWS)
def failed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one task and outcome."""
    return session_facts(spark, sf_dir).where(sessions.of_task("testing", F.col("action")) & (F.col("outcome") == "failed") & (F.col("outcome_confidence") == "high"))


@query(
    """SELECT sl.*, o2.lineage, o2.accounted, coalesce(t.calls, 0) AS calls, coalesce(t.failures, 0) AS failures, f.families FROM sl LEFT JOIN ac o2 USING (sid) LEFT JOIN (SELECT sid, count(*) AS calls, count(*) FILTER (result_status = 'failure') AS failures FROM fx_activity GROUP BY sid) t USING (sid)
      LEFT JOIN (SELECT sid, string_agg(family || '=' || n, ',' ORDER BY family) AS families FROM (SELECT sid, family, count(*) AS n FROM fx_messages GROUP BY ALL) GROUP BY sid) f USING (sid) WHERE sid::VARCHAR = '42'""",
    **SESSION_ROWS,
)
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session by the beginning of its id, with all that is known of it."""
    named = sessions.by_prefix(X.sessions(spark, sf_dir).select("sid", F.col("sid").cast("string").alias("id")), "id", "42").select("sid")
    one = lambda df: df.join(F.broadcast(named), "sid", "left_semi")  # one row
    families = one(X.messages(spark, sf_dir)).groupBy("sid", "family").agg(F.count("*").alias("n")).groupBy("sid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("family", "n"))), lambda x: F.concat_ws("=", x["family"], x["n"])), ",").alias("families"))
    acts = one(X.activity(spark, sf_dir)).groupBy("sid").agg(F.count("*").alias("calls"), F.count_if(F.col("result_status") == "failure").alias("failures"))
    known = accounted_sessions(spark, sf_dir).select("sid", "lineage", F.col("accounted.total_tokens").alias("accounted"))
    return one(session_facts(spark, sf_dir)).join(known, "sid", "left").join(acts, "sid", "left").join(families, "sid", "left").fillna(0, ["calls", "failures"])


# ---- exports: fixed columns behind the schema version and the dataset's name

def export(name: str, rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.orderBy(*order).select(F.lit(exports.VERSION).alias("export_schema_version"), F.lit(name).alias("dataset"), *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in exports.COLUMNS[name]])


def text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _export_sql(name: str, source: str, **known: str) -> str:
    return f"SELECT {exports.VERSION} AS export_schema_version, '{name}' AS dataset, " + ", ".join(f"{known.get(c, 'NULL::VARCHAR')} AS {c}" for c in exports.COLUMNS[name]) + " " + source


@query(_export_sql("sessions", "FROM fu", session_id="sid", client_kind="client_kind", started_at=_text("started_at"), apparent_ended_at=_text("ended_at"), repository_root="repository_root", repository_name="repository_name", model="model", model_provider="provider", archived="archived"), **FULL)
def sessions_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full(spark, sf_dir).select(F.col("sid").alias("session_id"), "client_kind", text("started_at").alias("started_at"), text("ended_at").alias("apparent_ended_at"), "repository_root", "repository_name", "model", F.col("provider").alias("model_provider"), "archived")
    return export("sessions", rows, F.asc_nulls_last("started_at"), "session_id")


@query(
    _export_sql("usage", "FROM fu LEFT JOIN ac USING (sid)", session_id="sid", started_at=_text("started_at"), repository="repository_name", model="model", usage_semantics="CASE WHEN ac.observed IS NOT NULL THEN 'cumulative_total' END", accounting_status="lineage", observed_rollout_total_tokens="observed", reconciled_local_total_tokens="accounted", inherited_replayed_baseline_total_tokens="baseline"),
    **(TOKENS | FULL),
)
def usage_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = {"input_tokens": "input_tokens", "cached_input_tokens": "cached_input_tokens", "cache_write_input_tokens": "cache_write_input_tokens", "output_tokens": "output_tokens", "reasoning_output_tokens": "reasoning_output_tokens", "total_tokens": "total_tokens"}
    rows = full_scoped(spark, sf_dir).select(F.col("sid").alias("session_id"), text("started_at").alias("started_at"), F.col("repository_name").alias("repository"), "model", F.col("semantics").alias("usage_semantics"), F.col("lineage").alias("accounting_status"), *[F.col(f"observed.{c}").alias(f"observed_rollout_{c}") for c in counters], *[F.col(f"accounted.{c}").alias(f"reconciled_local_{c}") for c in counters], F.col("baseline.total_tokens").alias("inherited_replayed_baseline_total_tokens"))
    return export("usage", rows, F.asc_nulls_last("started_at"), "session_id")


PROMPTS = EVENTS | FULL | {
    "re": RESOLVED,
    "pr": "SELECT p.sid, p.i, m.source_ordinal, x.text, x.fingerprint, row_number() OVER (PARTITION BY p.sid ORDER BY p.i) - 1 AS prompt_ordinal FROM (SELECT sid, i FROM re WHERE status = 'origin') p JOIN m USING (sid, i) JOIN fx_messages x ON x.sid = m.sid AND x.source_ordinal = m.source_ordinal JOIN fx_sessions f ON f.sid = p.sid WHERE m.family = 'user_message' AND client_kind IN ('cli', 'editor')",
    "se": "SELECT osid AS sid, oi AS i, count(DISTINCT sid) AS observation_sessions, count(DISTINCT CASE WHEN sid <> osid THEN sid END) AS replay_sessions FROM re WHERE status = 'origin' OR status LIKE 'inherited%' GROUP BY ALL",
    "pi": "SELECT pr.*, 'prm_' || sha256(pr.sid || chr(0) || source_ordinal || chr(0) || fingerprint) AS prompt_id, se.observation_sessions, se.replay_sessions FROM pr LEFT JOIN se USING (sid, i)",
}


def prompt_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical prompts, redacted, with the sessions that show and replay them."""
    resolved = resolved_events(spark, sf_dir)
    rows = prompts.observed(prompts.logical(X.messages(spark, sf_dir), resolved, X.sessions(spark, sf_dir)), resolved)
    return rows.withColumn("r", P.redacted(F.col("text"))).join(full(spark, sf_dir), "sid")


@query(
    _export_sql("prompts", "FROM pi JOIN fu USING (sid)", prompt_id="prompt_id", origin_session_id="sid", prompt_ordinal="prompt_ordinal", occurred_at=_text("started_at"), repository="repository_name", model="model", text_included="false", redaction_status="'none'", redaction_count="0", original_character_count="length(text)", stored_character_count="length(text)", provenance_status="'origin'", observation_session_count="observation_sessions", replay_session_count="replay_sessions"),
    **PROMPTS,
)
def prompts_rows_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the texts, as the policy may have it."""
    rows = exports.retained(prompt_facts(spark, sf_dir).withColumn("stored_redacted_prompt_text", F.col("r.text")), "stored_redacted_prompt_text", False)
    rows = rows.select("prompt_id", F.col("sid").alias("origin_session_id"), "prompt_ordinal", text("started_at").alias("occurred_at"), F.col("repository_name").alias("repository"), "model", "stored_redacted_prompt_text", F.lit(False).alias("text_included"), F.col("r.status").alias("redaction_status"), F.col("r.redactions").alias("redaction_count"), F.col("r.original_characters").alias("original_character_count"), F.col("r.stored_characters").alias("stored_character_count"), F.lit("origin").alias("provenance_status"), F.col("sessions").alias("observation_session_count"), F.col("replay_sessions").alias("replay_session_count"))
    return export("prompts", rows, F.asc_nulls_last("occurred_at"), "prompt_id")


@query(
    _export_sql("commands", "FROM cm JOIN fu USING (sid)", session_id="sid", occurred_at=_text("occurred_at"), repository="repository_name", model="model", command_category="command_category", stored_redacted_bounded_command_text="text", text_included="true", command_fingerprint="sha256(text)", executable="executable", command_operation="CASE WHEN executable = 'git' AND command_category = 'git_mutation' THEN 'git_commit' END", test_scope="test_scope", result_status="result_status", redacted="redacted", truncated="false", provenance_status="'origin'"),
    **FULL,
    cm=lines.SQL,
)
def commands_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tool_rows(spark, sf_dir).join(full(spark, sf_dir), "sid").select(F.col("sid").alias("session_id"), text("occurred_at").alias("occurred_at"), F.col("repository_name").alias("repository"), "model", "command_category", F.col("text").alias("stored_redacted_bounded_command_text"), F.lit(True).alias("text_included"), F.col("fingerprint").alias("command_fingerprint"), "executable", F.when(F.col("is_commit"), "git_commit").alias("command_operation"), "test_scope", "result_status", "redacted", "truncated", F.lit("origin").alias("provenance_status"))
    return export("commands", rows, F.asc_nulls_last("occurred_at"), "session_id")


@query(
    _export_sql("commits", "FROM tl JOIN fu USING (sid)", session_id="sid", repository="repository", commit_hash="commit_hash", committed_at=_text("committed_at"), confidence="['low', 'medium', 'high'][r]", evidence_type="['timing_candidate_after_originated_action', 'unique_compatible_commit_after_originated_action', 'originated_commit_result_hash'][r]", ambiguous="r = 1"),
    **(COMMITS | FULL),
)
def commits_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.col("tier") == "high", "originated_commit_result_hash").when(F.col("tier") == "medium", "unique_compatible_commit_after_originated_action").otherwise("timing_candidate_after_originated_action")
    rows = linked(spark, sf_dir).join(full(spark, sf_dir), "sid").select(F.col("sid").alias("session_id"), "repository", "commit_hash", text("committed_at").alias("committed_at"), F.col("tier").alias("confidence"), evidence.alias("evidence_type"), (F.col("tier") == "low").alias("ambiguous"))
    return export("commits", rows, "committed_at", "commit_hash", "session_id")


@query(_export_sql("outcomes", "FROM oc JOIN fx_sessions USING (sid)", session_id="sid", outcome="outcome", confidence="confidence"), **OUTCOMES)
def outcomes_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).join(X.sessions(spark, sf_dir).select("sid", "started_at"), "sid")
    return export("outcomes", rows.withColumnRenamed("sid", "session_id"), F.asc_nulls_last("started_at"), "session_id")


@query(_export_sql("tasks", "FROM tk JOIN fx_sessions USING (sid)", session_id="sid", action="action", domain="domain"), **TASKS)
def tasks_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets and confidence are checked by tests of the operator."""
    rows = session_task_rows(spark, sf_dir).select("sid", "action", "domain").join(X.sessions(spark, sf_dir).select("sid", "started_at"), "sid")
    return export("tasks", rows.withColumnRenamed("sid", "session_id"), F.asc_nulls_last("started_at"), "session_id")


GROUP = {"session_count": "sessions", "sessions_with_reconciled_token_data": "known_sessions", "reconciled_local_total_tokens": "total_tokens", "observed_rollout_total_tokens_sum": "observed_tokens", "observed_rollout_mean_tokens_per_session": "mean_tokens", "observed_rollout_median_tokens_per_session": "median_tokens", "observed_rollout_p90_tokens_per_session": "p90_tokens", "sessions_per_day": "sessions_per_day"}


def group_rows(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    rows, parts = usage.windowed(full_scoped(spark, sf_dir), contributions(spark, sf_dir))
    return usage.window_metrics(rows, usage.scope(rows, parts), *keys)


# all time: the days from the first start or event to the last
ALL = TOKENS | FULL | {
    "wr": "SELECT fu.*, ac.observed, u.used FROM fu LEFT JOIN ac USING (sid) LEFT JOIN (SELECT sid, sum(tokens)::BIGINT AS used FROM ct GROUP BY sid) u USING (sid)",
    "dy": "SELECT date_diff('day', min(d), max(d)) + 1 AS n FROM (SELECT started_at::DATE AS d FROM fx_sessions UNION ALL SELECT occurred_at::DATE FROM ct WHERE occurred_at IS NOT NULL AND sid IN (SELECT sid FROM fx_sessions))",
}
ALL_FIELDS = FIELDS.replace("count(*) / 10::DOUBLE", "count(*) / (SELECT n FROM dy)::DOUBLE")


@query(_export_sql("repositories", f"FROM (SELECT repository_root, {ALL_FIELDS} FROM wr GROUP BY ALL)", group_key="coalesce(repository_root, 'outside-git')", group_label="coalesce(split_part(repository_root, '/', 3), 'Outside Git repositories')", repository_root="repository_root", **GROUP), **ALL)
def repositories_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = group_rows(spark, sf_dir, "repository_root")
    rows = rows.select(F.coalesce("repository_root", F.lit("outside-git")).alias("group_key"), sessions.label(F.col("repository_root")).alias("group_label"), "repository_root", *[F.col(v).alias(k) for k, v in GROUP.items()])
    return export("repositories", rows, F.desc_nulls_last("reconciled_local_total_tokens"), F.desc("session_count"), F.lower("group_label"), "group_key")


@query(_export_sql("models", f"FROM (SELECT model, provider, {ALL_FIELDS} FROM wr GROUP BY ALL)", group_key="coalesce(model, 'unknown') || '::' || coalesce(provider, 'unknown')", group_label="coalesce(model, 'Unknown model')", model_provider="provider", **GROUP), **ALL)
def models_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = group_rows(spark, sf_dir, "model", "provider")
    rows = rows.select(F.concat_ws("::", F.coalesce("model", F.lit("unknown")), F.coalesce("provider", F.lit("unknown"))).alias("group_key"), F.coalesce("model", F.lit("Unknown model")).alias("group_label"), F.col("provider").alias("model_provider"), *[F.col(v).alias(k) for k, v in GROUP.items()])
    return export("models", rows, F.desc_nulls_last("reconciled_local_total_tokens"), F.desc("session_count"), F.lower("group_label"), "group_key")
