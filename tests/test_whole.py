"""Registered queries against the whole of their tables, told apart in Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from logloom.functions import prompts as P
from logloom.plans import more_queries as Q
from logloom.plans import views as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def activity(spark):
    return sorted((r.asDict() for r in X.activity(spark, SF).collect()), key=lambda r: (r["sid"], r["occurred_at"], r["event_id"]))


def test_task_report_is_of_all_prompts_and_activity(spark, activity):
    kinds, sums = defaultdict(set), defaultdict(lambda: [0] * len(P.ACTIONS))
    for r in activity:
        kinds[r["sid"]].add(r["command_category"])
    driven = {r["sid"] for r in X.sessions(spark, SF).collect() if r["client_kind"] != "subagent"}
    # children of several parents, and edges with an end on a cycle: whose events theirs are isn't known, so they have no prompts
    edges = {(r["parent"], r["child"]) for r in X.edges(spark, SF).collect()}
    up = defaultdict(set)
    for p, c in edges:
        up[c].add(p)
    above = {c: set(ps) for c, ps in up.items()}
    for _ in edges:
        above = {c: ps | {x for p in ps for x in above.get(p, ())} for c, ps in above.items()}
    cycle = {c for c, ps in above.items() if c in ps}
    driven -= {c for c, ps in up.items() if len(ps) > 1 or ({c} | ps) & cycle}
    first = set()
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        sid = r["conv_id"]
        if r["role"] != "user" or sid not in driven:  # replayed turns are in sessions of subagents only
            continue
        t = "\n".join(x for x in r["text"].split("\n") if not re.search(P.NEGATED, x))
        for k, (_, p) in enumerate(P.ACTIONS):
            sums[sid][k] += (2 if sid in first else 3) * min(3, len(list(re.finditer(p, t))))
        first.add(sid)
    want = defaultdict(int)
    for sid in set(kinds) | set(sums):
        top = max(sums[sid])
        rest = next((a for c, a in (("testing", "testing"), ("editing_patching", "implementation"), ("git_mutation", "git_or_release")) if c in kinds[sid]), "unknown")
        want[P.ACTIONS[sums[sid].index(top)][0] if top else rest] += 1
    assert {r["action"]: r["sessions"] for r in Q.task_report(spark, SF).collect()} == dict(want)


def test_outcomes_are_of_all_activity(spark, activity):
    commits = {r["commit_hash"]: r["committed_at"] for r in X.commits(spark, SF).collect()}
    high = defaultdict(list)
    for r in Q.linked(spark, SF).where("tier = 'high'").collect():
        high[r["sid"]].append(commits[r["commit_hash"]])
    by = defaultdict(list)
    for r in activity:
        by[r["sid"]].append(r)
    want = {}
    for sid, rows in by.items():
        seen, at = [], []
        for i, r in enumerate(rows):
            c, s = r["command_category"], r["result_status"]
            if c == "editing_patching" or (c == "testing" and s != "unknown"):
                seen.append((10 * i, "edit" if c == "editing_patching" else "validation_pass" if s == "success" else "validation_fail"))
                at.append((r["occurred_at"], 10 * i))
            elif c == "other":
                seen.append((10 * i + 5, "error" if s == "failure" else "abort" if r["event_id"] % 2 == 0 else "task_complete"))
        seen += [(max((q for t, q in at if t <= h), default=0) + 1, "high_commit") for h in high[sid]]
        last = defaultdict(lambda: -1, {kind: k for k, (_, kind) in enumerate(sorted(seen))})
        good = max(last["validation_pass"], last["high_commit"])
        if not seen:
            continue
        if last["abort"] > last["task_complete"]:
            want[sid] = "abandoned"
        elif last["validation_fail"] >= 0 and last["validation_pass"] <= last["validation_fail"] or last["error"] >= 0 and good <= last["error"]:
            want[sid] = "failed"
        elif last["validation_fail"] >= 0:
            want[sid] = "success_with_warnings"
        else:
            want[sid] = "success" if good >= 0 else "partial" if last["edit"] >= 0 else "unknown"
    assert any(high.values()) and {r["sid"]: r["outcome"] for r in Q.session_outcome(spark, SF).collect()} == want


def test_redaction_digests_the_whole_text(spark, tmp_path):
    text = "plain words " * 10_000
    spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    r = Q.prompt_redaction(spark, str(tmp_path)).first()
    assert len(text) > P.LIMIT and r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
