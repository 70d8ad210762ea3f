"""What jobs leave in the shared folder."""

import os
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from logloom.checkpoints import scratch, shared_folder
from logloom.llm.components import components
from logloom.operators import commits, history
from logloom.operators.upkeep import only
from logloom.plans.more_queries import judged_of

T0 = datetime(2024, 1, 1)


def tables(spark):
    return {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith(("table-", "scratch-"))}


def test_rounds_of_ancestry_leave_no_tables(spark):
    """Each round left its table: some forty for a line of 200, now only the result."""
    log = [("/r", f"{i:07x}" + "d" * 33, T0 + timedelta(minutes=i), [f"{i - 1:07x}" + "d" * 33] if i else []) for i in range(200)]
    h = spark.createDataFrame(log, "repository_root string, commit_hash string, committed_at timestamp, parents array<string>")
    asked = [(log[199][1], log[k][1][:12]) for k in (0, 100, 199)] + [(log[50][1], log[100][1][:9]), ("unknown", log[0][1])]
    before = tables(spark)
    found = history.descends(spark.createDataFrame(asked * 2, "commit_hash string, ancestor string"), h)
    assert sorted(map(tuple, found.collect())) == sorted(asked[:2])
    left = tables(spark) - before
    assert len(left) == 1 and not any(x.startswith("scratch-") for x in left)
    actions = spark.createDataFrame([(1, 1, "/r", T0, T0 + timedelta(minutes=3), "success", None, None)], "sid long, event_id long, repository_root string, occurred_at timestamp, until timestamp, result_status string, shown_hash string, start_hash string")
    sessions = spark.createDataFrame([(1, "/r", T0, None)], "sid long, repository_root string, started_at timestamp, ended_at timestamp")
    before = tables(spark)
    links, summary = commits.linked(actions, h, sessions)
    assert links.count() == 5 and summary.first()["considered"] == 14
    assert len(tables(spark) - before) <= 3 and not any(x.startswith("scratch-") for x in tables(spark) - before)


def test_scratch_goes_if_the_job_fails(spark):
    before = tables(spark)
    with pytest.raises(ValueError), scratch(spark) as t:
        a = t.put("a", spark.range(3))
        a = t.put("a", a.selectExpr("id + 1 AS id"))
        assert sorted(r.id for r in a.collect()) == [1, 2, 3] and len(t.paths) == 1
        raise ValueError
    assert tables(spark) == before


def test_outcomes_are_one_row_a_session_after_joins_by_shuffle(spark):
    """Evidence of three kinds is a union; of 50 sessions there came 150 rows, each of one kind."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    kind = F.element_at(F.array(*map(F.lit, ("testing", "editing_patching", "other"))), (F.col("id") % 3 + 1).cast("int"))
    act = spark.range(4000).select((F.col("id") % 100).alias("sid"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("occurred_at"), kind.alias("command_category"), F.lit("success").alias("result_status"))
    links = spark.range(100).select(F.col("id").alias("sid"), F.timestamp_seconds(1_700_002_000 + F.col("id")).alias("committed_at"), F.lit("high").alias("tier"))
    keys = spark.range(50).select(F.col("id").alias("sid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with scratch(spark) as t:
            act, links = t.put("act", act), t.put("links", links)
            got = t.put("got", judged_of(only(act, keys, "sid"), only(links, keys, "sid")))
            assert got.count() == 50 and got.exceptAll(judged_of(act, links).where("sid < 50")).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rounds_of_components_have_the_tasks_that_their_links_need(spark):
    """With 64 partitions each round wrote as many files, of a few rows or none."""
    before = {x: spark.conf.get(x) for x in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for x, v in zip(before, ("64", "false"), strict=True):
        spark.conf.set(x, v)
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7)], "a long, b long"))
        assert found.rdd.getNumPartitions() == 1
        assert dict(map(tuple, found.collect())) == dict.fromkeys(range(21), 0) | dict.fromkeys((100, 101, 102), 100)
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)
