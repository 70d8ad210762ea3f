"""Usage, lineage, provenance, outcomes, commands, prompts, commits and sources on small tables."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.functions import prompts as P
from logloom.functions import shell
from logloom.functions import vectors as V
from logloom.operators import commits, history, lineage, outcomes, provenance, search, sessions, tasks, tools, usage
from logloom.sources import catalogue, exports, records

T0 = datetime(2026, 8, 1)


def vec(total, inp=None, out=None, cached=None):
    return (inp, cached, out, None, None, total)


EVENTS = f"sid long, event_ordinal long, occurred_at timestamp, cumulative {V.TYPE}, delta {V.TYPE}"


def token_events(spark, series, deltas=None):
    rows = [(s, i, T0 + timedelta(minutes=i), vec(t), None) for s, ts in series.items() for i, t in enumerate(ts)]
    rows += [(s, i, T0 + timedelta(minutes=i), None, vec(t)) for s, ts in (deltas or {}).items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, EVENTS)


def verdict(spark, parent, child, pairs=((1, 2),)):
    rows = lineage.edge_verdicts(token_events(spark, {1: parent, 2: child}), spark.createDataFrame(list(pairs), "parent long, child long")).where("child = 2").collect()
    return rows[0]


def test_lineage_rules(spark):
    r = verdict(spark, [10, 40, 100], [10, 40, 100, 110, 120])
    assert (r["status"], r["matched"], r["baseline"]["total_tokens"], r["incremental"]["total_tokens"]) == ("inherited_prefix", 3, 100, 20)
    assert verdict(spark, [100], [80, 120])["status"] == "ambiguous"
    r = verdict(spark, [50, 100], [100, 130])
    assert (r["status"], r["incremental"]["total_tokens"]) == ("inherited_exact", 30)
    assert verdict(spark, [5], [0, 30])["status"] == "independent"
    assert verdict(spark, [5], [])["status"] == "unavailable"
    assert verdict(spark, [], [5])["evidence"] == "parent_token_data_unavailable"
    assert verdict(spark, [5], [5], ((1, 2), (2, 1)))["status"] == "cycle"
    # a prefix whose difference would be negative gives way to the next rule
    assert verdict(spark, [10, 40], [10, 40, 20])["status"] == "ambiguous"


def reached(edges, a):
    seen, new = set(), {a}
    while new:
        new = {c for p, c in edges if p in new} - seen
        seen |= new
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    """Cycles and depths against walking, in graphs of several parents, nested cycles and long chains."""
    r = random.Random(seed)
    n = 14
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([9, 14, 20]))} | {(100 + i, 101 + i) for i in range(9)} | {(109, r.randrange(n)), (r.randrange(n), 104)}
    found = {x["node"]: (x["depth"], x["cyclic"], x["on_cycle"]) for x in lineage.ancestry(spark.createDataFrame(sorted(edges), "parent long, child long")).collect()}
    nodes = {x for e in edges for x in e}
    on = {x for x in nodes if x in reached(edges, x)}
    below = on.union(*(reached(edges, x) for x in on))
    depth = {x: 0 for x in nodes if x not in {c for _, c in edges}}
    for _ in nodes:
        for p, c in edges:
            if p in depth and p not in on and c not in on:
                depth[c] = max(depth.get(c, 0), depth[p] + 1)
    assert found == {x: (depth.get(x) if x not in on else None, x in below, x in on) for x in nodes}


def test_ancestry(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (8, 9), (9, 10), (5, 5)], "parent long, child long")
    found = {r["node"]: (r["depth"], r["cyclic"], r["on_cycle"]) for r in lineage.ancestry(edges).collect()}
    assert found == {1: (0, False, False), 2: (1, False, False), 3: (2, False, False), 4: (3, False, False), 7: (None, True, True), 8: (None, True, True), 9: (None, True, False), 10: (None, True, False), 5: (None, True, True)}
    long = spark.createDataFrame([(i, i + 1) for i in range(70)], "parent long, child long")
    assert lineage.ancestry(long).agg(F.max("depth")).first()[0] == 70
    several = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1), (3, 4), (4, 5), (6, 5), (5, 7), (8, 6), (6, 7), (10, 11), (12, 11), (11, 13)], "parent long, child long")
    found = {r["node"]: (r["depth"], r["cyclic"], r["on_cycle"]) for r in lineage.ancestry(several).collect()}
    assert {n for n, (_, _, on) in found.items() if on} == {1, 2, 3} and found[9] == (0, False, False) and found[4] == (None, True, False)
    assert found[5] == (2, True, False) and found[7] == (3, True, False) and found[13] == (2, False, False)
    ids = spark.createDataFrame([(k,) for k in range(1, 13)], "sid long")
    t = lineage.topology(ids, several.union(spark.createDataFrame([(77, 1), (78, 79), (5, 5)], "parent long, child long"))).first()
    assert (t["edges"], t["valid_edges"], t["orphan_parents"], t["orphan_children"], t["self_edges"], t["several_parents"]) == (16, 13, 2, 2, 1, 4)
    assert (t["cycle_nodes"], t["roots"], t["depth"], t["multi_generation_trees"]) == (4, 4, 2, 1)
    down = lineage.descendants(edges, spark.createDataFrame([(2,), (9,)], "sid long"))
    assert {r["sid"] for r in down.collect()} == {2, 3, 4, 9, 10}
    below = lineage.descendants(long.union(spark.createDataFrame([(70, 100), (3, 100), (100, 101)], "parent long, child long")), spark.createDataFrame([(60,)], "sid long"))
    assert {r["sid"] for r in below.collect()} == {*range(60, 71), 100, 101}


def usage_of(spark, events, baseline=None, accounted=None):
    totals = usage.session_totals(events)
    base = F.lit(None).cast(V.TYPE) if baseline is None else F.struct(*[F.lit(x).cast("long").alias(f) for f, x in zip(V.FIELDS, vec(baseline))])
    acc = F.col("observed") if accounted is None else F.struct(*[F.lit(x).cast("long").alias(f) for f, x in zip(V.FIELDS, vec(accounted))])
    return totals.withColumn("baseline", base).withColumn("accounted", acc)


def test_attribution(spark):
    ev = token_events(spark, {1: [100, 120]})
    rows = usage.attributed(usage_of(spark, ev), ev).orderBy("occurred_at").collect()
    assert [(r["usage"]["total_tokens"], r["status"]) for r in rows] == [(100, "complete"), (20, "complete")]
    ev = token_events(spark, {1: [100, 90]})
    (r,) = usage.attributed(usage_of(spark, ev), ev).collect()
    assert (r["reason"], r["usage"]["total_tokens"], r["occurred_at"]) == ("nonmonotonic_cumulative_usage", 90, None)
    ev = token_events(spark, {1: [30, 50, 80]})
    rows = usage.attributed(usage_of(spark, ev, 30, 50), ev).collect()
    assert sorted(r["usage"]["total_tokens"] for r in rows) == [20, 30]
    ev = token_events(spark, {}, {1: [25, 25]})
    assert [r["usage"]["total_tokens"] for r in usage.attributed(usage_of(spark, ev), ev).collect()] == [25, 25]
    (r,) = usage.attributed(usage_of(spark, ev, None, 60), ev).collect()
    assert r["reason"] == "event_total_mismatch"


def test_usage_anchor(spark):
    """Four sessions: 150 tokens in all, two known, mean and median 75, p90 100; days with and without tokens."""
    s = spark.createDataFrame([(1, datetime(2026, 8, 1), "/r/one"), (2, datetime(2026, 8, 7, 12), "/r/one"), (3, datetime(2026, 8, 8, 23, 59, 59), None), (4, datetime(2026, 8, 9), "/r/two")], "sid long, started_at timestamp, repository_root string")
    rows = [(1, 0, datetime(2026, 8, 1, 0, 30), vec(100, 80, 20, 10), None), (3, 0, datetime(2026, 8, 8, 23, 59, 59), None, vec(25, 20, 5, 2)), (3, 1, datetime(2026, 8, 9, 0, 5), None, vec(25, 20, 5, 3))]
    ev = spark.createDataFrame(rows, EVENTS)
    known = lineage.accounted(usage.session_totals(ev), lineage.edge_verdicts(ev, spark.createDataFrame([], "parent long, child long")))
    scoped = s.join(known, "sid", "left")
    r = usage.by_dimension(scoped).first()
    assert (r["sessions"], r["tokens"], r["known_sessions"], r["mean_tokens"], r["median_tokens"], r["p90_tokens"]) == (4, 150, 2, 75, 75, 100)
    assert scoped.agg(F.sum("accounted.input_tokens"), F.sum("accounted.reasoning_output_tokens")).first()[:] == (120, None)
    by_day = {r["period"]: (r["sessions"], r["tokens"]) for r in usage.by_period(scoped, usage.attributed(known, ev), "day").collect()}
    assert by_day == {"2026-08-01": (1, 100), "2026-08-07": (1, None), "2026-08-08": (1, 25), "2026-08-09": (1, 25)}
    west = {r["period"] for r in usage.by_period(scoped, usage.attributed(known, ev), "day", "America/Los_Angeles").collect()}
    assert west == {"2026-07-31", "2026-08-07", "2026-08-08"}
    weeks = {r["period"] for r in usage.by_period(scoped, usage.attributed(known, ev), "week").collect()}
    assert weeks == {"2026-07-27", "2026-08-03"}
    repo = {r["repository_root"]: r["tokens"] for r in usage.by_dimension(scoped, "repository_root").collect()}
    assert repo == {"/r/one": 100, None: 50, "/r/two": None}


def provenance_of(spark, parent, child):
    rows = [(s, i, f, p, d) for s, es in ((1, parent), (2, child)) for i, (f, p, d) in enumerate(es)]
    ev = spark.createDataFrame(rows, "sid long, source_ordinal long, family string, fingerprint string, stable_id string")
    v = provenance.event_verdicts(ev, spark.createDataFrame([(1, 2)], "parent long, child long"))
    return ev, v, [r["status"] for r in v.orderBy("i").collect()]


def test_provenance(spark):
    base = [("user", "a", None), ("tool", "b", None), ("user", "c", None), ("tool", "d", None)]
    ev, v, found = provenance_of(spark, base, [*base, ("user", "x", None), ("tool", "y", None)])
    assert found == ["inherited_prefix"] * 4 + ["origin"] * 2
    assert provenance.replay_summary(v).where("inherited = 2").count() == 2
    tops = provenance.origins(ev, v, spark.createDataFrame([(1, 2)], "parent long, child long")).where("sid = 2").orderBy("i").collect()
    assert [(r["origin_sid"], r["origin_i"]) for r in tops] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    assert provenance_of(spark, [("tool", "b", None)], [("tool", "b", None)])[2] == ["ambiguous"]
    assert provenance_of(spark, [("tool", "b", "i1")], [("tool", "b", "i1"), ("tool", "b", "i2")])[2] == ["inherited_exact", "origin"]
    # a family's own run counts where other families lie between
    assert provenance_of(spark, [("user", "a", None), ("user", "c", None)], [("tool", "z", None), ("user", "a", None), ("user", "c", None)])[2] == ["origin", "inherited_prefix", "inherited_prefix"]


@pytest.mark.parametrize(
    ("kinds", "want"),
    [
        (["validation_fail", "validation_pass"], ("success_with_warnings", "medium")),
        (["validation_pass", "validation_fail"], ("failed", "high")),
        (["error"], ("failed", "medium")),
        (["error", "high_commit"], ("success", "medium")),
        (["task_complete", "abort"], ("abandoned", "high")),
        (["abort", "task_complete"], ("unknown", "low")),
        (["edit"], ("partial", "low")),
    ],
)
def test_outcomes(spark, kinds, want):
    ev = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "sid long, sequence long, kind string")
    r = outcomes.classified(ev).first()
    assert (r["outcome"], r["confidence"]) == want


@pytest.mark.parametrize(
    ("command", "typed", "category", "scope"),
    [
        ("cd x && FOO=1 sudo -u me pytest tests/test_a.py", "pytest", "testing", "file"),
        ("pytest", "pytest", "testing", "full_suite"),
        ("pytest -k name", "pytest", "testing", "subset"),
        ("uv run --frozen pytest -q", "uv", "testing", "full_suite"),
        ("python -m pytest", "python", "testing", "full_suite"),
        ("git commit -m 'x y'", "git", "git_mutation", "not_applicable"),
        ("git status | head", "git", "git_inspection", "not_applicable"),
        ("env -S 'a b' ls", None, "unknown", "not_applicable"),
        ("for f in *; do ls; done", None, "unknown", "not_applicable"),
        ("(ls)", None, "unknown", "not_applicable"),
        ("echo 'unclosed", None, "unknown", "not_applicable"),
        ("/usr/bin/rg foo", "rg", "text_search", "not_applicable"),
        ("npm install left-pad", "npm", "dependency_management", "not_applicable"),
        ("python run_orca.py", "python", "scientific_computation", "not_applicable"),
        ("cargo test", "cargo", "testing", "full_suite"),
        ("", None, "unknown", "not_applicable"),
    ],
)
def test_commands(spark, command, typed, category, scope):
    r = tools.classified(spark.createDataFrame([(command,)], "command string")).first()
    assert (r["executable"], r["command_category"], r["test_scope"]) == (typed, category, scope)


def test_command_redaction(spark):
    rows = ["curl -H 'Authorization: Bearer abc' x", "x --token abc; y", "A_KEY=1 password=hunter2 run", "cat <<EOF\nsecret\nEOF\n", "ls   -l", "x" * 600]
    found = [r["r"] for r in spark.createDataFrame([(c,) for c in rows], "c string").select(shell.redacted(F.col("c")).alias("r")).collect()]
    assert [r["redacted"] for r in found] == [True, True, True, True, False, False]
    assert found[0]["text"] == "curl -H 'Authorization: Bearer [REDACTED]' x" and found[3]["text"] == "cat <<EOF [HEREDOC REDACTED] EOF"
    assert found[4]["text"] == "ls -l" and found[5]["truncated"] and len(found[5]["text"]) == 512


def test_prompts(spark):
    texts = ["fix the bug\n- must add tests\nDo not commit", "api_key = abcdefgh and sk-abcdefghijklmnopqrst", "請修復這個錯誤 並提交更改", "What is this?", "", "plan: see src/a.py and /etc/x"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "sid long, prompt_ordinal int, text string")
    r = [x["r"] for x in df.orderBy("sid").select(P.redacted(F.col("text")).alias("r")).collect()]
    assert r[1]["redactions"] == 2 and r[1]["text"] == "api_key = [REDACTED] and [REDACTED TOKEN]" and r[0]["status"] == "none"
    f = [x["f"] for x in df.orderBy("sid").select(P.features(F.col("text")).alias("f")).collect()]
    assert (f[0]["requests_commit"], f[0]["has_non_goals"], f[0]["lines"], f[0]["requirements"]) == (False, True, 3, 2)
    assert f[2]["requests_commit"] and f[4]["lines"] == 0 and f[5]["paths"] == 2
    t = {x["sid"]: x for x in tasks.classified(df, spark.createDataFrame([(4, "testing"), (9, "git_mutation")], "sid long, command_category string")).collect()}
    assert [t[k]["action"] for k in range(6)] == ["bug_fix", "unknown", "bug_fix", "question_answering", "testing", "planning"]
    assert t[9]["action"] == "git_or_release" and t[9]["confidence"] == "medium" and t[0]["confidence"] == "high"


def test_search(spark, tmp_path):
    texts = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick the fox"), (3, "slow fox, quick brown dog"), (4, None)], "prompt_id long, text string")
    index = search.terms(search.postings(texts))
    ids = lambda **k: {r["prompt_id"] for r in search.search(index, **k).collect()}
    assert ids(every=["quick"]) == {1, 2, 3} and ids(every=["fox"], without=["slow"]) == {1, 2} and ids(every=["fox", "dog"]) == {3}
    assert ids(phrase=["quick", "brown"]) == {1, 3} and ids(prefix="bro") == {1, 3} and ids(some=["dog", "the"]) == {1, 2, 3}
    assert ids(every=["nothing", "fox"]) == ids(phrase=["brown", "quick"]) == set()
    assert [r[0] for r in texts.orderBy("prompt_id").select(search.snippets(texts, ["fox"], width=3, before=1)).collect()] == ["…brown [fox]", "…the [fox]", "slow [fox] quick…", None]


def test_words_are_grouped_within_their_text(spark):
    """The same index without a shuffle of words; ids that repeat go by the other way."""
    texts = [(1, "The fox, the dog: the end"), (2, "dog"), (3, None), (4, " !! "), (5, "a b " * 40 + "Ä ä")]
    df = spark.createDataFrame(texts, "prompt_id long, text string")
    rows = lambda found: sorted(tuple(r) for r in search.terms(found).collect())
    assert rows(search.indexed(df)) == rows(search.postings(df)) and "positions" in search.indexed(df).columns
    assert "Exchange" not in search.words_of(df)._jdf.queryExecution().executedPlan().toString()
    twice = df.union(df.where("prompt_id = 2"))
    assert rows(search.indexed(twice)) == rows(search.postings(twice)) and "pos" in search.indexed(twice).columns


@pytest.mark.parametrize("seed", range(2))
def test_best_reads_only_what_can_be_best(spark, tmp_path, seed):
    """The k best over any of some words, against all scores; equal texts tie."""
    r = random.Random(seed)
    texts = [(i, " ".join(r.choices(["a", "b", "c", "d", "e", "f"], [20, 8, 4, 2, 1, 30], k=r.choice([3, 10, 40])))) for i in range(400)] + [(1000, "c"), (1001, "c"), (1002, "")]
    search.write_terms(search.terms(search.postings(spark.createDataFrame(texts, "prompt_id long, text string"))), f"{tmp_path}/i", 1 << 12)
    index = spark.read.parquet(f"{tmp_path}/i")
    for words, k in ((["a", "c", "e"], 7), (["e"], 3), (["d", "zzz"], 1000), (["zzz"], 5)):
        every = sorted(((round(x["score"], 9), x["prompt_id"]) for x in search.search(index, some=words).collect()), reverse=True)
        got = sorted(((round(x["score"], 9), x["prompt_id"]) for x in search.best(index, words, k).collect()), reverse=True)
        least = every[min(k, len(every)) - 1][0] if every else 0
        assert got == every[: len(got)] and {x for x in every if x[0] >= least} <= set(got), (words, k)


def test_commits(spark):
    """Thirty commits after one action; a shown hash; a single commit after the session's start, with and without what MEDIUM asks for."""
    kind = "sid long, event_id long, repository_root string, occurred_at timestamp, until timestamp, result_status string, shown_hash string, start_hash string"
    m = lambda k: timedelta(minutes=k)
    c = lambda k: f"{k:040x}"
    log = [("/r", c(i), T0 + timedelta(seconds=20 * i), []) for i in range(1, 31)]
    log += [("/q", "abcdef1" + "0" * 33, T0 + timedelta(days=2), None)]
    for k, root in enumerate(("/m", "/n", "/o", "/p")):
        log += [(root, c(1000 + 10 * k + i), T0 + m(30 * i), [c(1000 + 10 * k + i - 1)] if i else None) for i in range(3)]
    actions = [
        (1, 10, "/r", T0, T0 + m(5), "success", None, None),
        (2, 20, "/q", T0, None, "success", "abcdef1", None),
        (3, 30, "/m", T0 + m(50), T0 + m(55), "success", None, c(1000)),  # descends from its start: medium
        (4, 40, "/n", T0 + m(50), T0 + m(55), "success", None, None),  # no start
        (5, 50, "/o", T0 + m(50), T0 + m(55), "success", None, c(1022)),  # the start itself is no candidate
        (6, 60, "/p", T0 + m(50), T0 + m(55), "success", None, c(1030)),  # another session is open
        (3, 31, "/m", T0 + m(50), None, "failure", c(1002)[:12], c(1000)),  # a failed action
    ]
    s = [(k, root, T0, T0 + m(200)) for k, root in enumerate(("/r", "/q", "/m", "/n", "/o", "/p"), 1)] + [(7, "/p", T0 + m(10), None)]
    tables = spark.createDataFrame(actions, kind), spark.createDataFrame(log, "repository_root string, commit_hash string, committed_at timestamp, parents array<string>"), spark.createDataFrame(s, "sid long, repository_root string, started_at timestamp, ended_at timestamp")
    links, summary = commits.linked(*tables)
    got = {}
    for r in links.collect():
        got.setdefault(r["sid"], []).append(r["tier"])
    assert got == {1: ["low"] * 5, 2: ["high"], 3: ["medium"], 4: ["low"], 6: ["low"]}
    assert {r["sid"]: (r["considered"], r["kept"], r["omitted"]) for r in summary.collect()} == {1: (30, 5, 25), 3: (2, 1, 1), 4: (1, 1, 0), 6: (1, 1, 0)}


def test_many_logs_in_a_file(spark, tmp_path):
    """Logs one after the other, over splits: places of their own; only the file's last line can be cut short. The queries' logs aren't a file each."""
    from logloom.plans import log_queries

    logs = {f"{k}": [f'{{"k":"{k}\\t{i}"}}' for i in range(1 + k % 7)] for k in range(60)}
    (tmp_path / "a.log").write_text("\n".join(f"{k}\t{line}" for k, log in logs.items() for line in log))
    (tmp_path / "b.log").write_text("x\t{}\nx\t{\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        rows = records.sections(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        got.setdefault(r["log"], []).append(r)
    assert {k: [r["line"] for r in log] for k, log in got.items()} == logs | {"x": ["{}", "{"]}
    assert all([r["ordinal"] for r in log] == list(range(len(log))) and [r["last"] for r in log] == [False] * (len(log) - 1) + [True] for log in got.values())
    assert {r["log"] for r in rows if not r["terminated"]} == {"59"}
    made = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(log_queries.log_files(spark, "/root/testdata/sf0.001")).count()
    assert made < spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()


def test_candidates_are_counted_not_paired(spark):
    """Actions of sessions that outlast their repository's history, at equal times, over days: counts and the nearest as of all pairs, and no more rows than the nearest."""
    r = random.Random(11)
    c = lambda k: f"{k:07x}" + "e" * 33
    log = [(f"/{i % 2}", c(i), T0 + timedelta(minutes=r.choice([7, 60, 200]) * r.randrange(60)) if i % 29 else None) for i in range(300)]
    actions = [(i % 9, i // 2 if i < 20 else i, f"/{i % 3}" if i % 11 else None, T0 + timedelta(minutes=60 * r.randrange(90)), T0 + timedelta(days=r.choice([1, 5, 400])) if i % 5 else None, "success", c(r.randrange(300))[:12].upper() if i % 4 else None) for i in range(150)]
    a = spark.createDataFrame(actions, "sid long, event_id long, repository_root string, occurred_at timestamp, until timestamp, result_status string, start_hash string")
    h = spark.createDataFrame(log, "repository_root string, commit_hash string, committed_at timestamp")
    every = commits.candidates(a, h)
    pairs = [(x["event_id"], x["occurred_at"], x["committed_at"], x["commit_hash"], x["n"]) for x in every.collect()]
    counts, found = commits.nearest(a, h, 3)
    assert sorted(map(tuple, counts.groupBy("sid").sum("n_own").collect())) == sorted(map(tuple, every.groupBy("sid").count().collect()))
    best = []
    for event in {x[0] for x in pairs}:
        best += sorted((x for x in pairs if x[0] == event), key=lambda x: (x[2] - x[1], x[2], x[3]))[:3]
    got = [(x["event_id"], x["occurred_at"], x["committed_at"], x["commit_hash"], x["n"]) for x in found.collect()]
    assert sorted(got) == sorted(best) and len(pairs) > 5 * len(got)


def test_candidates_meet_blocks_of_commits(spark, monkeypatch):
    """Sessions open for centuries, over block bounds: all pairs as by hand, and behind the join no window and no shuffle, which would move every pair."""
    monkeypatch.setattr(commits, "BLOCK_BITS", 3, raising=False)
    r = random.Random(5)
    c = lambda k: f"{k:07x}" + "d" * 33
    log = [(f"/{i % 2}" if i % 31 else None, c(i), T0 + timedelta(minutes=r.randrange(3000)) if i % 23 else None) for i in range(120)] + [("/0", c(2), T0)]
    actions = [(i % 9, i // 2 if i < 20 else i, f"/{i % 3}" if i % 11 else None, T0 + timedelta(minutes=r.randrange(-60, 3200)), T0 + timedelta(days=r.choice([1, 2, 90_000])) if i % 5 else None, c(r.randrange(120))[:12].upper() if i % 4 else "ab") for i in range(60)]
    a = spark.createDataFrame(actions, "sid long, event_id long, repository_root string, occurred_at timestamp, until timestamp, start_hash string").withColumn("result_status", F.lit("success"))
    found = commits.candidates(a, spark.createDataFrame(log, "repository_root string, commit_hash string, committed_at timestamp"))
    latest = lambda at, until: (until or at + timedelta(seconds=commits.OPEN)) + timedelta(seconds=commits.GRACE)
    want = [(s, e, x, at) for s, e, root, t, until, start in actions for home, x, at in log if root and home == root and at and t <= at <= latest(t, until) and not (len(start) >= 7 and x.startswith(start.lower()))]
    n = {e: sum(1 for w in want if w[1] == e) for _, e, _, _ in want}
    assert sorted(map(tuple, found.select("sid", "event_id", "commit_hash", "committed_at", "n").collect())) == sorted((*w, n[w[1]]) for w in want) and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Window" not in plan and "Exchange" not in plan.split("Join")[0]


def test_ancestry_of_a_long_line_takes_few_rounds(spark):
    """Over checkpoints, planning doubled with each round: a line of 3,000 had not ended after 100 seconds."""
    log = [("/r", f"{i:07x}" + "d" * 33, T0 + timedelta(minutes=i), [f"{i - 1:07x}" + "d" * 33] if i else []) for i in range(3000)]
    asked = [(log[2999][1], log[k][1][:12]) for k in (0, 1500, 2999)]
    began = time.time()
    found = history.descends(spark.createDataFrame(asked, "commit_hash string, ancestor string"), spark.createDataFrame(log, "repository_root string, commit_hash string, committed_at timestamp, parents array<string>"))
    assert {x["ancestor"] for x in found.collect()} == {asked[0][1], asked[1][1]}
    assert time.time() - began < 60


def test_ancestry_over_all_parents(spark):
    """Merges, branches of branches, clocks that run backwards, parents that nobody has read, and a long line, against walking."""
    r = random.Random(3)
    name = lambda i: f"{i:07d}" + "f" * 33
    parents = {i: [i - 1] for i in range(1, 70)} | {i: sorted(r.sample(range(max(70, i - 5), i), min(i - 70, r.choice([1, 1, 2]))), reverse=True) for i in range(70, 90)}
    parents |= {70: [500], 85: [84, 30]}
    log = [("/r", name(i), T0 + timedelta(minutes=i * r.choice([1, 1, 1, -3])) if i % 17 else None, [name(p) for p in ps]) for i, ps in parents.items()]
    pairs = [(i, k) for i in parents for k in (i - 1, i - 4, i - 20, 500, 0, 30, i) if k >= 0]

    def above(i):
        seen, new = set(), {i}
        while new:
            new = {p for x in new for p in parents.get(x, [])} - seen
            seen |= new
        return seen

    asked = spark.createDataFrame([(name(i), name(k)[:12]) for i, k in pairs], "commit_hash string, ancestor string")
    found = history.descends(asked, spark.createDataFrame(log, "repository_root string, commit_hash string, committed_at timestamp, parents array<string>"))
    assert {(int(a[:7]), int(b[:7])) for a, b in found.collect()} == {(i, k) for i, k in pairs if k in above(i)}
    assert history.descends(asked.limit(0), spark.createDataFrame([], "commit_hash string, committed_at timestamp, parents array<string>")).count() == 0


def test_events_of_a_child_of_two_parents_are_unknown(spark):
    ev = spark.createDataFrame([(s, i, "user", f"{i}", None) for s in (1, 2, 3) for i in range(3)], "sid long, source_ordinal long, family string, fingerprint string, stable_id string")
    edges = spark.createDataFrame([(1, 3), (2, 3)], "parent long, child long")
    rows = provenance.origins(ev, provenance.event_verdicts(ev, edges), edges).collect()
    assert {(r["sid"], r["status"]) for r in rows} == {(1, "origin"), (2, "origin"), (3, "unknown")}


def test_records(spark, tmp_path):
    lines = [
        '{"type":"session_meta","payload":{"type":"x","id":"a"}}',
        '{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":8,"output_tokens":"5"},"last_token_usage":{"input_tokens":3,"output_tokens":2}}}}',
        '{"event":"e","usage":{"prompt_tokens":4,"completion_tokens":true}}',
        "[1]",
        '{"broken":',
        '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"t","text":"hi"},{"text":"you"}]}}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = records.parsed(records.lines(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "ok", "malformed", "malformed", "ok"] and [r["ordinal"] for r in rows] == list(range(6))
    assert (rows[1]["cumulative"]["input_tokens"], rows[1]["cumulative"]["output_tokens"], rows[1]["cumulative"]["total_tokens"]) == (8, None, None)
    assert rows[1]["delta"]["total_tokens"] == 5 and rows[2]["delta"]["input_tokens"] == 4 and rows[2]["delta"]["output_tokens"] is None
    assert rows[5]["text"] == "hi\nyou" and rows[5]["role"] == "user" and rows[2]["record_type"] == "e"
    prof = {(r["path"], r["type"]): r["n"] for r in records.field_profile(spark.createDataFrame([('{"a":[{"b":"xy"},{"b":1}],"c":null}',)], "line string")).collect()}
    assert prof[("$.a[].b", "STRING")] == 1 and prof[("$.a[].b", "BIGINT")] == 1 and prof[("$.a", "ARRAY")] == 1


def test_catalogue(spark):
    df = spark.createDataFrame([("s1", "p", "1735689600", "2025-01-01T00:10:00Z", "cli", "git@Host.org:me/repo.git", "1"), (None, "p", None, None, None, None, None), ("s2", "q", "1735689600000", None, '{"subagent":1}', "https://u:p@host.org:8443/me/repo.git", "no")], "Session_ID string, path string, created_at string, ended_at string, source string, git_origin_url string, is_archived string")
    rows = {r["sid"]: r for r in catalogue.sessions(df).collect()}
    assert rows["s1"]["started_at"] == rows["s2"]["started_at"] and rows["s1"]["archived"] and not rows["s2"]["archived"]
    assert (rows["s1"]["client_kind"], rows["s2"]["client_kind"]) == ("cli", "subagent") and catalogue.without_id(df) == 1
    urls = df.where("git_origin_url IS NOT NULL").select(catalogue.remote(F.col("git_origin_url"))).collect()
    assert [u[0] for u in urls] == ["host.org/me/repo", "host.org:8443/me/repo"]


def test_exports_and_lookup(spark):
    df = spark.createDataFrame([("=1+1", True, [1]), ("  @x", False, []), ("ok", None, None)], "a string, b boolean, c array<int>")
    assert [r["a"] for r in exports.safe(df).collect()] == ["'=1+1", "'  @x", "ok"]
    ids = spark.createDataFrame([("abc1",), ("abc2",), ("x",)], "sid string")
    assert sessions.by_prefix(ids, "sid", "x").count() == 1
    with pytest.raises(LookupError):
        sessions.by_prefix(ids, "sid", "abc")
    with pytest.raises(LookupError):
        sessions.by_prefix(ids, "sid", "zz")


def test_streaming(spark, tmp_path):
    from logloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"type":"a"}\n{"type":"b"}\n')
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    q = ingest.ingest(lines, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_jobs(spark, tmp_path):
    from logloom.operators import jobs

    lines = lambda rows: records.parsed(spark.createDataFrame([(*r, False, True) if len(r) == 3 else r for r in rows], "sid long, ordinal long, line string, last boolean, terminated boolean"))
    first = jobs.upsert(None, lines([(1, 0, '{"type":"a"}'), (2, 0, '{"type":"b"}'), (9, 0, '{"type":"i"}')]))
    jobs.write(first, str(tmp_path / "t"))
    before = spark.read.parquet(str(tmp_path / "t"))
    # a malformed line in the middle is only left out; a last line cut short keeps what was there
    new = lines([(1, 0, '{"type":"z"}'), (1, 1, '{"type":"y"}'), (2, 0, '{"type":"c"}'), (2, 1, "{broken", True, False), (3, 0, '{"type":"c"}'), (3, 1, "{broken"), (3, 2, '{"type":"d"}')])
    after = jobs.upsert(before, new).cache()
    assert sorted((r["sid"], r["record_type"], r["stale"]) for r in after.where("sid < 9").collect()) == [(1, "y", False), (1, "z", False), (2, "b", True), (3, "c", False), (3, "d", False)]
    buckets = {r[0] for r in spark.range(1, 4).select(jobs.bucket(F.col("id"))).collect()}
    assert {r[0] for r in after.select(jobs.bucket(F.col("sid"))).distinct().collect()} <= buckets
    jobs.write(after, str(tmp_path / "t"))
    assert {r["sid"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1, 2, 3, 9}
    shapes = jobs.unknown_shapes(after, ["a", "b"], most=1).collect()
    assert sorted((r["sid"], r["name"], r["n"]) for r in shapes if r["sid"] < 9) == [(1, "__other__", 1), (1, "z", 1), (3, "__other__", 1), (3, "c", 1)]
    prints = {r["sid"]: r["fingerprint"] for r in jobs.schema_fingerprint(after).collect()}
    assert len({prints[k] for k in (1, 2, 3)}) == 3
    old, new = (spark.createDataFrame(r, "sid long, digest string") for r in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]))
    assert {r["state"]: r["sessions"] for r in jobs.counts(old, new).collect()} == {"unchanged": 1, "updated": 1, "discovered": 1}


def test_runs_of_one_key_are_linear(spark):
    """A parent and a child of one key over and over; and all cases against the plain search."""
    same = [7] * 50_000
    began = time.time()
    assert lineage.longest_prefix([*same, 8, *same], [*same, 9]) == (0, 50_000) and lineage.longest_prefix([1, 2], []) == (0, 0)
    assert time.time() - began < 5
    r = random.Random(1)
    rows, want = [[], []], {}
    for edge in range(40):
        p, c = ([r.choice("ab") for _ in range(r.randrange(12))] for _ in range(2))
        for side, keys in zip(rows, (p, c), strict=True):
            side += [(edge, i, k) for i, k in enumerate(keys)]
        runs = [(next((k for k in range(len(c) + 1) if k == len(c) or s + k == len(p) or p[s + k] != c[k])), -s) for s in range(len(p))]
        n, s = max(runs, default=(0, 0))
        if n:
            want[edge] = (-s, n)
    frames = [spark.createDataFrame(x, "e long, i long, key string") for x in rows]
    assert {x["e"]: (x["start"], x["matched"]) for x in lineage.prefix_runs(*frames, ["e"]).collect()} == want


def test_lines_of_many_splits(spark, tmp_path):
    """Ordinals follow the file though it is read in many splits; the last line is told."""
    for name, text in (("a.jsonl", "".join(f"line {i}\n" for i in range(3000))), ("b.jsonl", "one\ntwo"), ("c.jsonl", "\n")):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = records.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = {(x["file"][-7], x["ordinal"]): (x["line"], x["last"], x["terminated"]) for x in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(got["a", i] == (f"line {i}", i == 2999, True) for i in range(3000))
    assert got["b", 0] == ("one", False, False) and got["b", 1] == ("two", True, False) and got["c", 0] == ("", True, True) and len(got) == 3003


def test_sweep_of_open_sessions(spark):
    """Who else is open at a commit's time, against asking each session; a year-long one, ends and beginnings at the same instant."""
    r = random.Random(9)
    h = lambda k: T0 + timedelta(hours=k)
    s = [(k, f"/{k % 2}", h(a := r.randrange(200)), r.choice([None, h(a + r.randrange(0, 60)), h(a + 8760), h(a - 1)]) if k % 5 == 0 else h(a + r.randrange(0, 9))) for k in range(40)]
    found = [(k, 100 * k + j, f"/{k % 2}", f"c{j}", h(r.randrange(220))) for k in range(40) for j in range(3)]
    df = spark.createDataFrame(found, "sid long, event_id long, repository_root string, commit_hash string, committed_at timestamp")
    got = {(x["event_id"], x["commit_hash"]) for x in commits.uncontested(df, spark.createDataFrame(s, "sid long, repository_root string, started_at timestamp, ended_at timestamp")).collect()}
    free = lambda k, root, t: not any(o != k and q == root and a <= t and (z is None or t <= z) and (z is None or z >= a) for o, q, a, z in s)
    assert got == {(e, c) for k, e, root, c, t in found if free(k, root, t)} and got


def test_quantiles(spark):
    """Against sorting: ties, one value, negative and very large ones, null keys and null values, and no key at all."""
    from logloom.operators import quantiles

    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 0, r.randrange(-50, 50), r.randrange(10**15)])) for _ in range(500)] + [("one", 7), ("none", None)] + [("many", 5)] * 30 + [("many", 6)] * 3
    df = spark.createDataFrame(rows, "g string, v long")
    wanted = {"m": (0.5, "cont"), "q": (0.9, "cont"), "d": (0.9, "disc")}
    for keys in (("g",), ()):
        groups = {}
        for g, v in rows:
            if v is not None:
                groups.setdefault((g,) if keys else (), []).append(v)
        got = {tuple(x[k] for k in keys): (x["m"], x["q"], x["d"]) for x in quantiles.exact(df, keys, F.col("v"), wanted).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            vs = sorted(vs)
            cont = lambda p: (lambda at: vs[int(at)] + (vs[min(len(vs) - 1, int(at) + 1)] - vs[int(at)]) * (at - int(at)))(p * (len(vs) - 1))  # noqa: E731, B023
            assert got[g][2] == vs[-(-9 * len(vs) // 10) - 1] and all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(got[g][:2], (cont(0.5), cont(0.9)), strict=True))


def test_sessions_come_in_few_files_of_a_stream(spark, tmp_path, monkeypatch):
    """Many files: each session is in a bounded number of them, its steps in their order."""
    from logloom.plans import job_queries

    monkeypatch.setattr(job_queries, "SLICE_ROWS", 100)
    monkeypatch.setattr(job_queries, "written", lambda spark, sf_dir, name, write: write(str(tmp_path / name)) or str(tmp_path / name))
    rows = spark.createDataFrame([(s, k) for s in range(80) for k in range(40)], "sid long, event_ordinal long")
    job_queries.stream_of(spark, "", "counted", rows, by="event_ordinal", within="sid")
    found = {}
    for x in spark.read.parquet(str(tmp_path / "stream_counted-slices")).collect():
        found.setdefault(x["sid"], []).append((x["event_ordinal"], x["slice"]))
    assert len({s for v in found.values() for _, s in v}) > 24 and sum(map(len, found.values())) == 3200
    for v in found.values():
        slices = [s for _, s in sorted(v)]
        assert slices == sorted(slices) and 2 <= len(set(slices)) <= 8
