"""Parameters, events of record lines, exports, reports and coverage on small tables."""

import json
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from logloom import params
from logloom.operators import coverage, jobs, reports
from logloom.sources import catalogue, census, events, exports, records


def test_time_ranges():
    now = datetime(2026, 8, 10, 12, tzinfo=UTC)
    west = params.zone("America/Los_Angeles")
    assert params.time_range("7d", None, now) == (datetime(2026, 8, 3, 12, tzinfo=UTC), None)
    assert params.time_range("2026-08-01", "2026-08-02", now, west) == (datetime(2026, 8, 1, 7, tzinfo=UTC), datetime(2026, 8, 3, 7, tzinfo=UTC))
    assert params.time_range(None, "2026-08-01T10:00:00Z", now)[1] == datetime(2026, 8, 1, 10, tzinfo=UTC)
    assert params.time_range("2026-08-01T10:00", None, now, west)[0] == datetime(2026, 8, 1, 17, tzinfo=UTC)
    for a, z in (("", None), ("soon", None), ("2026-08-02", "2026-08-01"), ("1d", "2d")):
        with pytest.raises(ValueError):
            params.time_range(a, z, now)
    with pytest.raises(ValueError):
        params.zone("Mars/Olympus")
    assert params.zone("utc") is UTC and params.zone(None) is not None


def test_periods():
    west = params.zone("America/Los_Angeles")
    assert params.period("week", date(2026, 8, 12), UTC) == (datetime(2026, 8, 10, tzinfo=UTC), datetime(2026, 8, 17, tzinfo=UTC))
    assert params.period("month", date(2026, 12, 31), west) == (datetime(2026, 12, 1, 8, tzinfo=UTC), datetime(2027, 1, 1, 8, tzinfo=UTC))
    assert params.period_before("month", datetime(2026, 3, 1, tzinfo=UTC), UTC) == (datetime(2026, 2, 1, tzinfo=UTC), datetime(2026, 3, 1, tzinfo=UTC))
    # a week in which the clock is set forward is an hour shorter
    a, z = params.period("week", date(2026, 3, 8), west)
    assert (z - a).total_seconds() == (7 * 24 - 1) * 3600
    w = params.local_windows(datetime(2026, 8, 12, 3, tzinfo=UTC), west)
    assert w["today"] == (datetime(2026, 8, 11, 7, tzinfo=UTC), datetime(2026, 8, 12, 7, tzinfo=UTC)) and w["week"][0] == datetime(2026, 8, 10, 7, tzinfo=UTC)


def rec(kind, payload, **more):
    return json.dumps({"type": kind, "payload": payload, **more})


LINES = [
    rec("response_item", {"type": "message", "role": "user", "id": "a", "content": [{"type": "input_text", "text": "hi"}, {"type": "input_image", "url": "u"}]}),
    rec("response_item", {"content": [{"text": "hi", "type": "input_text"}, {"url": "u", "type": "input_image"}], "role": "user", "type": "message", "id": "b"}),
    rec("event_msg", {"type": "user_message", "message": "hi", "images": ["x"]}),
    rec("event_msg", {"type": "agent_message", "message": "ok"}),
    rec("inter", {"type": "agent_message", "message": "ok"}),
    rec("response_item", {"type": "function_call", "name": "Shell", "arguments": '{"command": "pytest -q"}', "call_id": 7}),
    rec("response_item", {"type": "function_call", "name": "edit", "arguments": "{}"}),
    rec("event_msg", {"type": "patch_apply_end", "success": False, "stdout": "s"}),
    rec("event_msg", {"type": "turn_aborted", "reason": "user"}),
    rec("event_msg", {"type": "task_failed"}),
    rec("event_msg", {"type": "token_count"}),
    rec("response_item", {"type": "message", "role": "system"}),
    "[1]",
]


def test_events(spark):
    rows = events.typed(spark.createDataFrame(list(enumerate(LINES)), "ordinal long, line string"))
    found = {r["ordinal"]: r for r in events.extracted(rows).collect()}
    assert {k: r["family"] for k, r in found.items()} == {0: "user_message", 1: "user_message", 2: "user_message", 3: "assistant_message", 4: "inter_agent_message", 5: "validation_command", 6: "patch_edit", 7: "patch_result", 8: "task_lifecycle", 9: "error"}
    # the order of fields and the id are no content; attachments are
    assert found[0]["fingerprint"] == found[1]["fingerprint"] != found[2]["fingerprint"] and found[0]["stable_id"] != found[1]["stable_id"] and found[2]["stable_id"] is None
    assert found[0]["text"] == "hi" and found[0]["content_length"] == 2 and found[3]["text"] is None


def test_calls_and_results(spark):
    script = 'await tools.exec_command({"cmd": "git commit -m \'a b\'", "o": {"p": {"q": "}"}}}); tools.wait( )'
    lines = [
        rec("r", {"type": "custom_tool_call", "name": "js", "input": json.dumps({"code": script}), "call_id": "x"}),
        rec("r", {"type": "tool_call", "tool_name": "mcp__files", "arguments": "no json"}),
        rec("r", {"type": "function_call_output", "call_id": "x", "output": json.dumps({"exit_code": 1, "wall_time_seconds": 2, "output": "[main abc1234] m\n" + "f" * 40})}),
        rec("r", {"type": "function_call_output", "call_id": "y", "output": [{"text": "words"}, {"text": '{"ok": true, "output": 5}'}]}),
        rec("r", {"type": "function_call_output", "call_id": "z", "output": {"exit_code": True, "isError": True, "wall_time_seconds": -1}}),
        rec("r", {"type": "function_call_output", "call_id": "w", "output": "words"}),
    ]
    rows = events.typed(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "sid long, ordinal long, line string"))
    calls = sorted(events.classed(events.calls(rows)).collect(), key=lambda r: (r["ordinal"], r["operation_ordinal"]))
    assert [(r["tool_name"], r["tool_family"], r["command_category"], r["operation"]) for r in calls] == [("exec_command", "shell", "git_mutation", "git_commit"), ("wait", "collaboration", "wait_poll", None), ("mcp__files", "network", "other", None)]
    got = {r["ordinal"]: r for r in events.results(rows).collect()}
    assert [got[k]["result_status"] for k in (2, 3, 4, 5)] == ["failure", "success", "failure", "unknown"]
    assert (got[2]["exit_code"], got[2]["duration_seconds"], got[2]["commit_hash"], got[2]["commit_short"]) == (1, 2.0, "f" * 40, "abc1234")
    assert got[4]["exit_code"] is None and got[4]["duration_seconds"] is None and got[3]["commit_short"] is None


def test_a_last_line_cut_short(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"a"}\n{"typ')
    (tmp_path / "b.jsonl").write_text('{"type":"a"}\n{"typ\n')
    rows = records.parsed(records.lines(spark, str(tmp_path))).collect()
    assert sorted((r["file"][-7:], r["ordinal"], r["status"]) for r in rows) == [("a.jsonl", 0, "ok"), ("a.jsonl", 1, "partial"), ("b.jsonl", 0, "ok"), ("b.jsonl", 1, "malformed")]


def test_exports(spark, tmp_path):
    exports.write(spark.createDataFrame([("=1", 1), ("b", 2)], "a string, n long"), str(tmp_path / "e"), name="things", about={"policy": "all"})
    about = spark.read.json(str(tmp_path / "e" / "about")).first()
    assert (about["dataset"], about["row_count"], about["columns"], about["policy"]) == ("things", 2, ["a", "n"], "all")
    assert {r["a"] for r in spark.read.option("header", True).csv(str(tmp_path / "e" / "rows")).collect()} == {"'=1", "b"}
    table, n = jobs.purged(spark.createDataFrame([("git commit -m x", None), ("ls", None), (None, "git_commit")], "t string, o string"), "t", "o")
    assert n == 2 and sorted(str(r["o"]) for r in table.collect()) == ["None", "git_commit", "git_commit"] and table.where("t IS NOT NULL").count() == 0


def test_reports(spark):
    now, before = (spark.createDataFrame([x], "sessions long, tokens long, coverage double") for x in ((10, None, 0.9), (5, 7, 0.6)))
    rows = {r["metric"]: r for r in reports.changes(now, before, ["sessions", "tokens"], "coverage").collect()}
    assert (rows["sessions"]["change"], rows["sessions"]["percentage_change"], rows["sessions"]["comparable"]) == (5, None, False) and rows["tokens"]["change"] is None
    assert reports.changes(now, now, ["sessions"], "coverage").first()["percentage_change"] == 0
    one = reports.notes(spark.createDataFrame([("session-of-a-long-name", 5, 9), ("b", 5, None), ("c", None, 9)], "id string, total_tokens long, seconds long")).collect()
    assert [(r["reason"], r["session_id"]) for r in one] == [("highest_observed_rollout_total", "session-of-a")]
    facts = spark.createDataFrame([(f"o{k % 2}", k % 3 == 0, k < 4, 1) for k in range(16)], "outcome string, f boolean, g boolean, feature_prompts long")
    found = {r["feature"]: r for r in reports.feature_outcomes(facts, ["f", "g"]).collect()}
    assert found["f"]["eligible"] and found["f"]["with_outcomes"] == "o0=3,o1=3" and not found["g"]["eligible"] and found["g"]["with_outcomes"] is None
    rows = spark.createDataFrame([(0, 0, 0, ["fallback_repository_name"], "x", "y", "cli"), (0, 0, 0, [], "unknown", "unknown", "subagent"), (0, 1, 0, [], "x", "y", "cli"), (2, 0, 0, [], "unknown", "y", "cli")], "prompts long, activity long, commits long, evidence array<string>, action string, domain string, client_kind string")
    assert reports.task_evidence(rows).first()[:] == (1, 1, 1, 1, 1, 1, 1)


def test_coverage_states(spark):
    facts = spark.createDataFrame([(1, *[None] * 15, False, False, False), (2, *[0] * 15, True, True, True), (3, *[2] * 15, False, True, True)], "sid long, " + ", ".join(f"{c} long" for c in coverage.CAPABILITIES) + ", partial_line boolean, odd_tools boolean, unresolved boolean")
    rows = {(r["sid"], r["capability"]): r["status"] for r in coverage.matrix(facts).collect()}
    assert {v for (s, _), v in rows.items() if s == 1} == {"unknown"} and {v for (s, _), v in rows.items() if s == 3} == {"available"}
    assert {c for (s, c), v in rows.items() if s == 2 and v == "degraded"} == {"rollout_metadata", "tool_activity", "command_extraction", "provenance_matching"}


def test_paths_and_names(spark):
    rows = spark.createDataFrame([(1, "a/./b"), (2, "/home/u/../v/x"), (3, None), (4, "/home/u/c")], "sid long, path string")
    got = {r["sid"]: (r["path"], r["status"]) for r in catalogue.placed(rows, "/home/u", spark.createDataFrame([("/home/u/a/b",)], "path string")).collect()}
    assert got == {1: ("/home/u/a/b", "present"), 2: ("/home/v/x", "outside_home"), 3: (None, "no_path"), 4: ("/home/u/c", "missing")}
    names = spark.createDataFrame([(" Ab_c ",), ("é",), ("x" * 129,)], "n string").select(census.safe_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["ab_c", census.UNSAFE, census.UNSAFE]
    typed = events.typed(spark.createDataFrame([(1, i, json.dumps({"type": f"new{i}", "payload": {"type": "task_rolled"}})) for i in range(5)], "sid long, ordinal long, line string"))
    found = {(r["kind"], r["name"]): r["n"] for r in census.unknown(typed, most=3).collect()}
    assert found == {("record_type", "new0"): 1, ("record_type", "new1"): 1, ("record_type", "new2"): 1, ("record_type", census.MORE): 2, ("payload_type", "task_rolled"): 5}


def test_the_entry_is_imported_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
