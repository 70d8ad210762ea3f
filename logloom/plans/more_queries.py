"""Activity, prompts, tasks, commits, outcomes, periods and coverage over the views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import prompts as P
from logloom.operators import commits, coverage, history, jobs, outcomes, prompts, search, tasks, tools, usage
from logloom.sources import exports, records

from . import commands as lines
from . import views as X
from .queries import EVENTS, TOKENS, accounted_sessions, contributions, query, resolved_events
from .stored import TABLES, stored, written


RESOLVED = "SELECT tr.sid, tr.i, ts AS osid, ti AS oi, CASE WHEN tr.status LIKE 'inherited%' AND t IN ('ambiguous', 'unknown') THEN 'ambiguous' ELSE tr.status END AS status FROM tr JOIN og o ON o.sid = ts AND o.i = ti WHERE o.up IS NULL"


@query(
    """SELECT count(*) AS calls, count(DISTINCT sid) AS sessions, count(*) FILTER (command_category = 'testing') AS tests, count(*) FILTER (command_category IN ('git_inspection', 'filesystem_inspection', 'text_search')) AS inspections,
      count(*) FILTER (command_category = 'editing_patching') AS edits, count(*) FILTER (result_status = 'failure') AS failures, count(*) FILTER (result_status <> 'unknown') AS known_results,
      count(*) FILTER (result_status = 'failure') / count(*) FILTER (result_status <> 'unknown') AS failure_rate FROM fx_activity"""
)
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.summary(X.activity(spark, sf_dir))


@query("SELECT command_category, count(*) AS calls FROM fx_activity GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.top(X.activity(spark, sf_dir), "command_category", 10)


@stored
def tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the command lines: one row per call, with the safe command and its class."""
    return tools.classified(lines.commands(X.activity(spark, sf_dir)))


@query(
    """SELECT sha256(text) AS fingerprint, count(*) AS runs, count(DISTINCT sid) AS sessions, epoch_us(min(occurred_at)) AS first_at, epoch_us(max(occurred_at)) AS last_at, bool_or(redacted) AS any_redacted, false AS any_truncated, min(text) AS text
    FROM cm GROUP BY text HAVING count(*) >= 2 ORDER BY runs DESC, lower(text) LIMIT 20""",
    cm=lines.SQL,
)
def repeated_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tools.repeated(tool_rows(spark, sf_dir), limit=20)
    return found.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


@query("SELECT executable, command_category, test_scope, is_commit, redacted, count(*) AS n FROM cm GROUP BY ALL", cm=lines.SQL)
def command_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and scopes of commands behind what stands before them."""
    return tool_rows(spark, sf_dir).groupBy("executable", "command_category", "test_scope", "is_commit", "redacted").agg(F.count("*").alias("n"))


@query("SELECT sid, sum(n)::BIGINT AS calls, sum(failed)::BIGINT AS failures FROM (SELECT sid, command_category, count(*) AS n, count(*) FILTER (result_status = 'failure') AS failed FROM fx_activity GROUP BY ALL) GROUP BY sid")
def session_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.per_session(X.activity(spark, sf_dir)).drop("categories")


def _redaction_sql() -> str:
    count, text = [], "text"
    for p, by in P.REDACTIONS:
        p = p.replace("'", "''")
        count.append(f"len(regexp_extract_all({text}, '{p}'))")
        text = f"regexp_replace({text}, '{p}', '{by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return f"SELECT prompt_id, {' + '.join(count)} AS redactions, sha256({text}) AS text_sha256, length(text) AS original_characters FROM fx_prompts"


@query(_redaction_sql())
def prompt_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.prompts(spark, sf_dir).select("prompt_id", P.redacted(F.col("text")).alias("r"))
    return rows.select("prompt_id", "r.redactions", "r.text_sha256", "r.original_characters")


def prompt_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of words, in the order in which searches read it."""
    return spark.read.parquet(written(spark, sf_dir, "prompt_terms", lambda path: search.write_terms(search.terms(search.indexed(X.prompts(spark, sf_dir))), path)))


TABLES["prompt_terms"] = prompt_terms


@stored
def prompt_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prompts(spark, sf_dir).select("prompt_id", P.features(F.col("text")).alias("f")).select("prompt_id", "f.*")


# the other engine's word boundaries know ASCII letters only
LETTERS = "regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g')"


def _features_sql() -> str:
    q = {k: v.replace("'", "''") for k, v in P.FEATURES.items()}
    n = lambda t, k: f"len(regexp_extract_all({t}, '{q[k]}'))"
    positive = f"array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l, '{q['non_goal']}')), chr(10))"
    return f"""SELECT prompt_id, length(text) AS characters, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS lines, {n("t", "acceptance")} > 0 AS has_acceptance_criteria, {n("p", "validation")} > 0 AS requests_validation,
      {n("p", "commits")} > 0 AS requests_multiple_commits, {n("t", "non_goal")} > 0 AS has_non_goals, {n("t", "read_only")} > 0 AS has_read_only_constraint
      FROM (SELECT *, {positive} AS p FROM (SELECT prompt_id, text, regexp_replace({LETTERS}, '\\r\\n?', chr(10), 'g') AS t FROM fx_prompts))"""


@query(_features_sql())
def prompt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_feature_table(spark, sf_dir).select("prompt_id", *(c for c in ("characters", "lines", "has_acceptance_criteria", "requests_validation", "requests_multiple_commits", "has_non_goals", "has_read_only_constraint")))


@query()
def prompt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counting features (their patterns look behind, which the other engine cannot)."""
    return prompt_feature_table(spark, sf_dir).select("prompt_id", "headings", "paths", "requests_commit", "requirements")


@query(
    """SELECT prompt_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
    FROM tf JOIN (SELECT token, count(*) AS df FROM tf GROUP BY token) USING (token) JOIN ln USING (prompt_id), (SELECT count(*) AS n, avg(l) AS mean FROM ln)
    WHERE prompt_id IN (SELECT prompt_id FROM tf WHERE token = 'the') AND prompt_id IN (SELECT prompt_id FROM tf WHERE token IN ('of', 'und')) AND token IN ('the', 'of', 'und') AND prompt_id NOT IN (SELECT prompt_id FROM po WHERE token = 'der') GROUP BY prompt_id""",
    po="SELECT prompt_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS token FROM fx_prompts",
    ln="SELECT prompt_id, count(*) AS l FROM po GROUP BY 1",
    tf="SELECT prompt_id, token, count(*) AS tf FROM po WHERE token IN ('the', 'of', 'und', 'der') GROUP BY ALL",
)
def prompt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = prompt_terms(spark, sf_dir)
    return search.search(index, every=["the"], some=["of", "und"], without=["der"]).withColumn("score", F.round("score", 6))


# score of each text over the words asked for; the words of a text in order, and where the first hit stands
SCORED = {
    "po": "SELECT prompt_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM fx_prompts",
    "pw": "SELECT prompt_id, len(ws) AS l, unnest(ws) AS token FROM po",
    "ln": "SELECT count(*) AS n, avg(l) AS mean FROM (SELECT len(ws) AS l FROM po WHERE len(ws) > 0)",
}


def _hits_sql(hit: str, keep: str) -> str:
    shown = f"list_transform(ws[at_ + 1 : at_ + 18], lambda w: CASE WHEN {hit.format('w')} THEN '[' || w || ']' ELSE w END)"
    return f"""SELECT prompt_id, score, (CASE WHEN at_ > 0 THEN '…' ELSE '' END) || array_to_string({shown}, ' ') || (CASE WHEN at_ + 18 < len(ws) THEN '…' ELSE '' END) AS snippet
      FROM (SELECT prompt_id, ws, greatest(list_position(list_transform(ws, lambda w: {hit.format('w')}), true) - 1 - 4, 0) AS at_ FROM po) JOIN (
        SELECT prompt_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
        FROM (SELECT prompt_id, token, l, count(*) AS tf FROM pw WHERE {hit.format('token')} GROUP BY ALL) JOIN (SELECT token, count(DISTINCT prompt_id) AS df FROM pw GROUP BY token) USING (token), ln GROUP BY prompt_id) USING (prompt_id)
      WHERE {keep} ORDER BY score DESC, prompt_id LIMIT 20"""


def shown(spark: SparkSession, sf_dir: str, hits: DataFrame, words: list[str], prefix: str | None = None) -> DataFrame:
    """The twenty best, in order, with their snippets."""
    top = hits.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "prompt_id").limit(20)
    texts = X.prompts(spark, sf_dir).join(F.broadcast(top), "prompt_id")  # twenty rows
    return texts.select("prompt_id", "score", search.snippets(texts, words, prefix=prefix).alias("snippet")).orderBy(F.desc("score"), "prompt_id")


@query(_hits_sql("{} IN ('of', 'und', 'thatin')", "true"), **SCORED)
def prompt_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all texts that have one of some words."""
    words = ["of", "und", "thatin"]
    return shown(spark, sf_dir, search.best(prompt_terms(spark, sf_dir), words, 20), words)


@query(_hits_sql("{} IN ('of', 'the')", "list_contains(list_transform(range(1, len(ws)), lambda i: ws[i] = 'of' AND ws[i + 1] = 'the'), true)"), **SCORED)
def prompt_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two words one after the other."""
    words = ["of", "the"]
    return shown(spark, sf_dir, search.search(prompt_terms(spark, sf_dir), phrase=words), words)


@query(_hits_sql("starts_with({}, 'thatin')", "true"), **SCORED)
def prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word that begins so."""
    return shown(spark, sf_dir, search.search(prompt_terms(spark, sf_dir), prefix="thatin"), [], "thatin")


def _tasks_sql() -> str:
    n = lambda p: f"least(3, len(regexp_extract_all(t, '{p}')))"
    best = lambda rules: "CASE WHEN greatest(" + ", ".join(n(p) for _, p in rules) + ") = 0 THEN 'unknown' " + " ".join(f"WHEN {n(p)} = greatest({', '.join(n(x) for _, x in rules)}) THEN '{name}'" for name, p in rules) + " END"
    negated = P.NEGATED.replace("'", "''")
    return f"""SELECT prompt_id AS sid, {best(P.ACTIONS)} AS action, {best(P.DOMAINS)} AS domain
      FROM (SELECT prompt_id, array_to_string(list_filter(string_split({LETTERS}, chr(10)), lambda l: NOT regexp_matches(l, '{negated}')), chr(10)) AS t FROM fx_prompts)"""


@query(_tasks_sql())
def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.prompts(spark, sf_dir).select(F.col("prompt_id").alias("sid"), F.lit(0).alias("prompt_ordinal"), "text")
    return tasks.classified(rows).select("sid", "action", "domain")


COMMITS = {
    "sh": "SELECT s.sid, s.repository_root, s.started_at, s.ended_at, CASE WHEN s.sid % 3 <> 0 THEN upper(substr(arg_max(c.commit_hash, (c.committed_at, c.commit_hash)), 1, 12)) END AS start_hash FROM fx_sessions s LEFT JOIN fx_commits c ON c.repository_root = s.repository_root AND c.committed_at < s.started_at + INTERVAL 10 DAY GROUP BY s.sid, s.repository_root, s.started_at, s.ended_at",
    "ca": "SELECT a.sid, event_id, s.repository_root, a.occurred_at, coalesce(s.ended_at, a.occurred_at + INTERVAL 1800 SECOND) + INTERVAL 600 SECOND AS latest, a.result_status, CASE WHEN event_id % 3 = 0 THEN substr(sha256('c' || event_id), 1, 12) END AS shown, lower(start_hash) AS start_hash FROM fx_activity a JOIN sh s USING (sid) WHERE command_category = 'git_mutation' AND s.repository_root IS NOT NULL",
    "hi": "SELECT sid, event_id, min(c.commit_hash) AS commit_hash, min(c.committed_at) AS committed_at FROM ca JOIN fx_commits c ON c.repository_root = ca.repository_root AND starts_with(c.commit_hash, shown) WHERE result_status = 'success' GROUP BY sid, event_id HAVING count(*) = 1",
    "cn": "SELECT ca.sid, ca.event_id, ca.repository_root, c.commit_hash, c.committed_at, ca.result_status, ca.occurred_at, ca.start_hash, count(*) OVER (PARTITION BY ca.event_id) AS n FROM ca JOIN fx_commits c ON c.repository_root = ca.repository_root AND c.committed_at BETWEEN ca.occurred_at AND ca.latest AND NOT coalesce(starts_with(c.commit_hash, ca.start_hash), false) WHERE event_id NOT IN (SELECT event_id FROM hi)",
    # up from the commits asked about, over all parents
    "pa": "SELECT commit_hash, unnest(parents) AS parent FROM fx_commits",
    "anc": "SELECT DISTINCT cn.commit_hash AS node, cn.commit_hash AS top FROM cn WHERE n = 1 AND start_hash IS NOT NULL UNION SELECT anc.node, pa.parent FROM anc JOIN pa ON pa.commit_hash = anc.top",
    "un": "SELECT cn.* FROM cn WHERE n = 1 AND EXISTS (SELECT 1 FROM anc WHERE anc.node = cn.commit_hash AND anc.top <> anc.node AND starts_with(anc.top, cn.start_hash))",
    "me": "SELECT sid, event_id, commit_hash, committed_at FROM un WHERE result_status = 'success' AND NOT EXISTS (SELECT 1 FROM fx_sessions s WHERE s.repository_root = un.repository_root AND s.sid <> un.sid AND s.started_at <= un.committed_at AND (s.ended_at IS NULL OR un.committed_at <= s.ended_at))",
    "rs": "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(committed_at) - epoch_us(occurred_at)), committed_at, commit_hash) AS k FROM cn WHERE (event_id, commit_hash) NOT IN (SELECT (event_id, commit_hash) FROM un)",
    "ta": "SELECT sid, commit_hash, max(r) AS r, min(committed_at) AS committed_at FROM (SELECT sid, commit_hash, committed_at, 3 AS r FROM hi UNION ALL SELECT sid, commit_hash, committed_at, 2 FROM me UNION ALL SELECT sid, commit_hash, committed_at, 1 FROM rs WHERE k <= 5 UNION ALL SELECT sid, commit_hash, committed_at, 1 FROM un) GROUP BY sid, commit_hash",
    "tl": "SELECT * FROM ta WHERE r > 1 UNION ALL SELECT sid, commit_hash, r, committed_at FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY committed_at, commit_hash) AS q FROM ta WHERE r = 1) WHERE q <= 20",
    "cs": "SELECT sid, count(*) AS considered, coalesce(any_value(k), 0) AS kept, greatest(count(*) - coalesce(any_value(k), 0), 0) AS omitted FROM cn LEFT JOIN (SELECT sid, count(*) AS k FROM tl WHERE r < 3 GROUP BY sid) USING (sid) GROUP BY sid",
}


def actions_of(s: DataFrame, history: DataFrame, activity: DataFrame) -> DataFrame:
    """Commit actions of sessions, two thirds of which tell the commit that they started from."""
    shown = F.when(F.col("event_id") % 3 == 0, F.substring(F.sha2(F.concat(F.lit("c"), F.col("event_id").cast("string")), 256), 1, 12))
    c = history.select(F.col("repository_root").alias("cr"), "commit_hash", "committed_at")
    # the last commit before the tenth day, by the order of one union
    s = s.where("repository_root IS NOT NULL")
    days = s.where("sid % 3 <> 0").select("sid", "repository_root", F.timestamp_micros(F.unix_micros("started_at") + 864_000_000_000).alias("at"), F.lit(None).cast("string").alias("commit_hash"), F.lit(0).alias("turn"))
    line = days.union(c.select(F.lit(None).cast("long"), "cr", "committed_at", "commit_hash", F.lit(1)))
    last = F.last("commit_hash", ignorenulls=True).over(W.partitionBy("repository_root").orderBy("at", "turn", "commit_hash").rowsBetween(W.unboundedPreceding, -1))
    start = line.withColumn("start_hash", F.upper(F.substring(last, 1, 12))).where("turn = 0").select("sid", "start_hash")
    s = s.select("sid", "repository_root", F.col("ended_at").alias("until")).join(start, "sid", "left")
    return activity.where("command_category = 'git_mutation'").join(s, "sid").select("sid", "event_id", "repository_root", "occurred_at", "until", "result_status", shown.alias("shown_hash"), "start_hash")


def commit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_of(X.sessions(spark, sf_dir), X.commits(spark, sf_dir), X.activity(spark, sf_dir))


@query("SELECT sid, event_id, commit_hash, count(*) OVER (PARTITION BY event_id) AS n FROM (SELECT ca.sid, ca.event_id, c.commit_hash FROM ca JOIN fx_commits c ON c.repository_root = ca.repository_root AND c.committed_at BETWEEN ca.occurred_at AND ca.latest AND NOT coalesce(starts_with(c.commit_hash, ca.start_hash), false))", **COMMITS)
def commit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.candidates(commit_actions(spark, sf_dir), X.commits(spark, sf_dir)).select("sid", "event_id", "commit_hash", "n")


@stored
def commit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and summaries in one table: a summary has no commit."""
    links, summary = commits.linked(commit_actions(spark, sf_dir), X.commits(spark, sf_dir), X.sessions(spark, sf_dir))
    return links.unionByName(summary, allowMissingColumns=True)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_links(spark, sf_dir).where("commit_hash IS NOT NULL").select("sid", "commit_hash", "committed_at", "tier")


def commit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_links(spark, sf_dir).where("commit_hash IS NULL").select("sid", "considered", "kept", "omitted")


@query("SELECT sid, commit_hash, ['low', 'medium', 'high'][r] AS tier FROM tl", **COMMITS)
def commit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).select("sid", "commit_hash", "tier")


@query("SELECT * FROM cs", **COMMITS)
def candidate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_summaries(spark, sf_dir)


@query(
    """SELECT count(*) FILTER (r = 3) AS high, count(*) FILTER (r = 2) AS medium, count(*) FILTER (r = 1) AS low, count(DISTINCT commit_hash) AS commits, count(DISTINCT sid) AS sessions, count(DISTINCT commit_hash) FILTER (r > 1) AS confirmed,
      (SELECT sum(accounted)::BIGINT FROM ac WHERE sid IN (SELECT sid FROM tl WHERE r > 1)) AS tokens, (SELECT sum(considered)::BIGINT FROM cs) AS considered, (SELECT sum(omitted)::BIGINT FROM cs) AS omitted,
      (SELECT sum(accounted)::BIGINT FROM ac WHERE sid IN (SELECT sid FROM tl WHERE r > 1)) / count(DISTINCT commit_hash) FILTER (r > 1)::DOUBLE AS tokens_per_confirmed FROM tl""",
    **(TOKENS | COMMITS),
)
def commit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.report(linked(spark, sf_dir), commit_summaries(spark, sf_dir), accounted_sessions(spark, sf_dir))


@query(
    "SELECT commit_hash, ancestor FROM bk WHERE EXISTS (SELECT 1 FROM anc WHERE node = commit_hash AND top <> node AND starts_with(top, ancestor))",
    bk="SELECT commit_hash, substr(unnest([lag(commit_hash) OVER h, lag(commit_hash, 5) OVER h]), 1, 10) AS ancestor FROM fx_commits WINDOW h AS (PARTITION BY repository_root ORDER BY committed_at, commit_hash)",
    pa=COMMITS["pa"],
    anc="SELECT commit_hash AS node, commit_hash AS top FROM fx_commits UNION SELECT anc.node, pa.parent FROM anc JOIN pa ON pa.commit_hash = anc.top",
)
def commit_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each commit and the ones made just and five before it, the pairs in which it descends from that one."""
    c = X.commits(spark, sf_dir)
    order = W.partitionBy("repository_root").orderBy("committed_at", "commit_hash")
    back = c.select("commit_hash", F.array(F.lag("commit_hash").over(order), F.lag("commit_hash", 5).over(order)).alias("b"))
    pairs = back.select("commit_hash", F.explode("b").alias("b")).where("b IS NOT NULL")
    return history.descends(pairs.select("commit_hash", F.substring("b", 1, 10).alias("ancestor")), c)


OUTCOMES = {
    **COMMITS,
    "ao": "SELECT *, row_number() OVER (PARTITION BY sid ORDER BY occurred_at, event_id) - 1 AS o FROM fx_activity",
    "oe": """
      SELECT sid, o * 10 AS q, CASE WHEN command_category = 'editing_patching' THEN 'edit' WHEN result_status = 'success' THEN 'validation_pass' ELSE 'validation_fail' END AS kind, occurred_at FROM ao
        WHERE command_category = 'editing_patching' OR (command_category = 'testing' AND result_status <> 'unknown')
      UNION ALL SELECT sid, o * 10 + 5, CASE WHEN result_status = 'failure' THEN 'error' WHEN event_id % 2 = 0 THEN 'abort' ELSE 'task_complete' END, NULL FROM ao WHERE command_category = 'other'""",
    "hc": "SELECT sid, committed_at AS t FROM tl WHERE r = 3",
    "hp": "SELECT hc.sid, max(oe.q) AS q, hc.t FROM hc LEFT JOIN oe ON oe.sid = hc.sid AND oe.occurred_at <= hc.t GROUP BY hc.sid, hc.t",
    "al": "SELECT sid, q, kind FROM oe UNION ALL SELECT hc.sid, coalesce(hp.q, 0) + 1, 'high_commit' FROM hc JOIN hp ON hp.sid = hc.sid AND hp.t = hc.t",
    "pl": "SELECT sid, kind, row_number() OVER (PARTITION BY sid ORDER BY q, kind) AS at_ FROM al",
    "ls": "SELECT sid, " + ", ".join(f"coalesce(max(at_) FILTER (kind = '{k}'), -1) AS {k}" for k in outcomes.KINDS) + " FROM pl GROUP BY sid",
    "oc": """SELECT sid, CASE WHEN abort > task_complete THEN 'abandoned' WHEN validation_fail >= 0 AND validation_pass <= validation_fail THEN 'failed' WHEN error >= 0 AND greatest(validation_pass, high_commit) <= error THEN 'failed'
      WHEN validation_fail >= 0 THEN 'success_with_warnings' WHEN greatest(validation_pass, high_commit) >= 0 THEN 'success' WHEN edit >= 0 THEN 'partial' ELSE 'unknown' END AS outcome,
      CASE WHEN abort > task_complete OR (validation_fail >= 0 AND validation_pass <= validation_fail) THEN 'high' WHEN error >= 0 AND greatest(validation_pass, high_commit) <= error OR validation_fail >= 0 OR greatest(validation_pass, high_commit) >= 0 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN abort > task_complete THEN 'aborted' WHEN task_complete >= 0 THEN 'turn_completed' ELSE 'unknown' END AS lifecycle FROM ls""",
}


def judged_of(activity: DataFrame, links: DataFrame) -> DataFrame:
    """Outcomes from all activity, errors, aborts and completions told from the rest of the kinds, and commits linked with high confidence."""
    a = activity.withColumn("source_ordinal", (F.row_number().over(W.partitionBy("sid").orderBy("occurred_at", "event_id")) - 1).cast("long"))
    life = a.where("command_category = 'other'").select("sid", "source_ordinal", F.when(F.col("result_status") == "failure", "error").when(F.col("event_id") % 2 == 0, "abort").otherwise("task_complete").alias("kind"))
    return outcomes.classified(outcomes.evidence(a, life, links.where("tier = 'high'").select("sid", "committed_at")))


@stored
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_of(X.activity(spark, sf_dir), linked(spark, sf_dir))


@query("SELECT * FROM oc", **OUTCOMES)
def session_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


@query("SELECT outcome, confidence, count(*) AS sessions, count(*) FILTER (outcome <> 'unknown' AND confidence IN ('high', 'medium')) AS strong FROM oc GROUP BY outcome, confidence", **OUTCOMES)
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.report(judged(spark, sf_dir))


def _session_tasks_sql() -> dict[str, str]:
    """Tasks of sessions: logical prompts by the rules, the activity where none has a hit."""
    def n(p: str) -> str:
        return f"least(3, len(regexp_extract_all(t, '{p}'))) * w"

    sums = ", ".join(f"sum({n(p)}) AS {k}{i}" for k, rules in (("a", P.ACTIONS), ("d", P.DOMAINS)) for i, (_, p) in enumerate(rules))
    best = lambda k, rules: "CASE WHEN greatest(" + ", ".join(f"coalesce({k}{i}, 0)" for i in range(len(rules))) + ") = 0 THEN NULL " + " ".join(f"WHEN {k}{i} = greatest(" + ", ".join(f"{k}{j}" for j in range(len(rules))) + f") THEN '{name}'" for i, (name, _) in enumerate(rules)) + " END"
    negated = P.NEGATED.replace("'", "''")
    letters = LETTERS.replace("text", "m.text")
    return {
        "re": RESOLVED,
        "lp": f"SELECT p.sid, CASE WHEN row_number() OVER (PARTITION BY p.sid ORDER BY m.source_ordinal) = 1 THEN 3 ELSE 2 END AS w, array_to_string(list_filter(string_split({letters}, chr(10)), lambda l: NOT regexp_matches(l, '{negated}')), chr(10)) AS t FROM re p JOIN m AS k ON k.sid = p.sid AND k.i = p.i JOIN fx_messages m ON m.sid = k.sid AND m.source_ordinal = k.source_ordinal JOIN fx_sessions f ON f.sid = p.sid WHERE p.status = 'origin' AND k.family = 'user_message' AND client_kind IN ('cli', 'editor')",
        "ps": f"SELECT sid, {sums} FROM lp GROUP BY sid",
        "ak": "SELECT sid, bool_or(command_category = 'testing') AS testing, bool_or(command_category = 'editing_patching') AS editing, bool_or(command_category = 'git_mutation') AS git FROM fx_activity GROUP BY sid",
        "tk": f"SELECT sid, coalesce({best('a', P.ACTIONS)}, CASE WHEN testing THEN 'testing' WHEN editing THEN 'implementation' WHEN git THEN 'git_or_release' ELSE 'unknown' END) AS action, coalesce({best('d', P.DOMAINS)}, CASE WHEN testing OR editing THEN 'software_engineering' WHEN git THEN 'git_release' ELSE 'unknown' END) AS domain, ps.sid IS NOT NULL AND greatest(" + ", ".join(f"coalesce({k}{i}, 0)" for k, rules in (("a", P.ACTIONS), ("d", P.DOMAINS)) for i in range(len(rules))) + ") > 0 AS by_prompt FROM ps FULL JOIN ak USING (sid)",
    }


TASKS = {**EVENTS, **_session_tasks_sql()}


@query("SELECT sid, action, domain FROM tk", **TASKS)
def session_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_task_rows(spark, sf_dir).select("sid", "action", "domain")


@query(
    "SELECT action, count(*) AS sessions, sum(accounted)::BIGINT AS tokens, count(accounted) AS known_sessions, median(accounted) AS median_tokens, quantile_cont(accounted, 0.9) AS p90_tokens, count(*) FILTER (outcome LIKE 'success%') AS successes FROM tk LEFT JOIN ac USING (sid) LEFT JOIN oc USING (sid) GROUP BY action",
    **(TOKENS | TASKS | OUTCOMES),
)
def task_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, known = session_task_rows(spark, sf_dir), accounted_sessions(spark, sf_dir).select("sid", F.col("accounted.total_tokens").alias("tokens"))
    return tasks.report(kinds.join(known, "sid", "left").join(judged(spark, sf_dir).select("sid", "outcome"), "sid", "left"), "action")


@stored
def session_task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks told by the prompts, by the activity where no rule has a hit."""
    events = X.messages(spark, sf_dir)
    return tasks.classified(prompts.logical(events, resolved_events(spark, sf_dir), X.sessions(spark, sf_dir)), X.activity(spark, sf_dir))


def _in(column: str, a: str, b: str) -> str:
    return f"{column} >= TIMESTAMP '{a}' AND {column} < TIMESTAMP '{b}'"


@query(
    f"""SELECT coalesce(s.repository_root, 'none') AS repository, s.sessions, t.tokens, coalesce(c.calls, 0) AS calls FROM (SELECT repository_root, count(*) AS sessions FROM fx_sessions WHERE {_in("started_at", "2024-01-01", "2024-01-08")} GROUP BY 1) s
    LEFT JOIN (SELECT repository_root, sum(tokens)::BIGINT AS tokens FROM ct JOIN fx_sessions USING (sid) WHERE {_in("occurred_at", "2024-01-01", "2024-01-08")} GROUP BY 1) t ON t.repository_root IS NOT DISTINCT FROM s.repository_root
    LEFT JOIN (SELECT repository_root, count(*) AS calls FROM fx_activity JOIN fx_sessions USING (sid) WHERE {_in("occurred_at", "2024-01-01", "2024-01-08")} GROUP BY 1) c ON c.repository_root IS NOT DISTINCT FROM s.repository_root""",
    **TOKENS,
)
def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week by repository: sessions by start, tokens and calls by their own times."""
    return usage.period_table(X.sessions(spark, sf_dir), contributions(spark, sf_dir), X.activity(spark, sf_dir), datetime(2024, 1, 1), datetime(2024, 1, 8)).withColumn("repository", F.coalesce("repository", F.lit("none")))


@query(
    f"""SELECT a.s AS sessions, b.s AS sessions_before, a.t AS tokens, b.t AS tokens_before, CASE WHEN b.t > 0 THEN (a.t - b.t) / b.t::DOUBLE END AS tokens_change
    FROM (SELECT (SELECT count(*) FROM fx_sessions WHERE {_in("started_at", "2024-01-08", "2024-01-15")}) AS s, (SELECT sum(tokens)::BIGINT FROM ct WHERE {_in("occurred_at", "2024-01-08", "2024-01-15")}) AS t) a,
      (SELECT (SELECT count(*) FROM fx_sessions WHERE {_in("started_at", "2024-01-01", "2024-01-08")}) AS s, (SELECT sum(tokens)::BIGINT FROM ct WHERE {_in("occurred_at", "2024-01-01", "2024-01-08")}) AS t) b""",
    **TOKENS,
)
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.comparison(X.sessions(spark, sf_dir), contributions(spark, sf_dir), datetime(2024, 1, 8), datetime(2024, 1, 15))


CAPABILITIES = {
    "cp": "SELECT sid, unnest(['repository', 'model', 'end_time', 'token_usage']) AS capability, unnest([repository_root IS NOT NULL, model IS NOT NULL, ended_at IS NOT NULL, sid IN (SELECT sid FROM fx_token_events)]) AS available FROM fx_sessions",
}


@query("SELECT capability, count(*) AS sessions, count(*) FILTER (available) AS available, count(*) FILTER (available) / count(*)::DOUBLE AS ratio FROM cp GROUP BY capability", **CAPABILITIES)
def coverage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.snapshot(coverage.capabilities(X.sessions(spark, sf_dir), X.token_totals(spark, sf_dir)))


@query(
    "SELECT run, capability, available / sessions::DOUBLE AS ratio, lag(available / sessions::DOUBLE) OVER (PARTITION BY capability ORDER BY run) AS ratio_before FROM (SELECT sid % 3 AS run, capability, count(*) AS sessions, count(*) FILTER (available) AS available FROM cp GROUP BY ALL)",
    **CAPABILITIES,
)
def coverage_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs told by the id, each against the one before."""
    rows = coverage.capabilities(X.sessions(spark, sf_dir), X.token_totals(spark, sf_dir)).withColumn("run", F.col("sid") % 3)
    return coverage.against_previous(coverage.snapshot(rows, "run")).select("run", "capability", "ratio", "ratio_before")


@query("SELECT '$.k' AS path, 'BIGINT' AS type, count(*) AS n FROM events WHERE props LIKE '{\"k\": %'")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and types of the events' JSON, never values."""
    return records.field_profile(X.read(spark, sf_dir, "events").select(F.col("props").alias("line"))).select("path", "type", "n")


@query("SELECT sid, count(*) AS lines, count(*) FILTER (own = 1 AND role = 'user') AS prompts, max(CASE WHEN role = 'assistant' THEN length(text) END) AS total_tokens FROM (SELECT conv_id AS sid, 1 AS own, role, text FROM conversations) GROUP BY sid")
def rollout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as record lines, read back by the log reader."""
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    tokens = F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(F.length("text").alias("total_tokens")).alias("total_token_usage")).alias("info"))
    conv = X.read(spark, sf_dir, "conversations")
    lines = conv.select(F.col("conv_id").alias("sid"), (2 * F.col("turn")).alias("ordinal"), F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("line"))
    counts = conv.where("role = 'assistant'").select(F.col("conv_id").alias("sid"), (2 * F.col("turn") + 1).alias("ordinal"), F.to_json(F.struct(F.lit("event_msg").alias("type"), tokens.alias("payload"))).alias("line"))
    parsed = records.parsed(lines.union(counts))
    return parsed.groupBy("sid").agg(F.count_if(F.col("payload_type") == "message").alias("lines"), F.count_if((F.col("payload_type") == "message") & (F.col("role") == "user")).alias("prompts"), F.max("cumulative.total_tokens").alias("total_tokens"))


@query("SELECT prompt_id, CASE WHEN regexp_matches(text, '^\\s*[=+@-]') THEN '''' || text ELSE text END AS text FROM fx_prompts")
def prompts_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.safe(X.prompts(spark, sf_dir).select("prompt_id", "text"))


@query("SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS day, sum(inc)::BIGINT AS tokens FROM ai WHERE inc > 0 GROUP BY 1", **TOKENS)
def raw_daily_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive steps of the adjusted counters by day, before sessions are judged."""
    known = accounted_sessions(spark, sf_dir)
    c = X.token_totals(spark, sf_dir).join(known.select("sid", F.col("baseline.total_tokens").alias("b")), "sid")
    w = W.partitionBy("sid").orderBy("event_ordinal")
    a = c.withColumn("a", F.greatest(F.col("cumulative_total") - F.coalesce("b", F.lit(0)), F.lit(0)))
    return a.withColumn("inc", F.col("a") - F.coalesce(F.lag("a").over(w), F.lit(0))).where("inc > 0").groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("day")).agg(F.sum("inc").alias("tokens"))


@query(
    """SELECT p.sid, p.i, row_number() OVER (PARTITION BY p.sid ORDER BY p.i) - 1 AS prompt_ordinal, s.sessions, s.replays FROM (SELECT re.sid, re.i FROM re JOIN m ON m.sid = re.sid AND m.i = re.i JOIN fx_sessions f ON f.sid = re.sid WHERE re.status = 'origin' AND family = 'user_message' AND client_kind IN ('cli', 'editor')) p
    LEFT JOIN (SELECT osid, oi, count(DISTINCT sid) AS sessions, count(*) FILTER (sid <> osid) AS replays FROM re WHERE status = 'origin' OR status LIKE 'inherited%' GROUP BY ALL) s ON s.osid = p.sid AND s.oi = p.i""",
    **EVENTS,
    re=RESOLVED,
)
def prompt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts once each, with the sessions that show and that replay them."""
    events = X.messages(spark, sf_dir)
    resolved = resolved_events(spark, sf_dir)
    rows = prompts.observed(prompts.logical(events, resolved, X.sessions(spark, sf_dir)), resolved)
    return rows.select("sid", "i", "prompt_ordinal", "sessions", "replays")


@query("SELECT sid, count(*) FILTER (cumulative_total < p) AS decreases, 0 AS component_over_total FROM (SELECT sid, cumulative_total, lag(cumulative_total) OVER (PARTITION BY sid ORDER BY event_ordinal) AS p FROM fx_token_events) GROUP BY sid")
def token_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.token_warnings(X.token_events(spark, sf_dir))
