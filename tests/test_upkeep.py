"""The session index: what a change reaches is made anew, and nothing else is written; the result is that of a fresh build."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from logloom.operators import upkeep
from logloom.operators.upkeep import Store, Table
from logloom.plans import index

CONV = "conv_id long, turn int, role string, text string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def sources(spark, path, turns, events):
    spark.createDataFrame(turns, CONV).repartition(2).write.parquet(f"{path}/conversations.parquet")
    raw = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, value double, props string")
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")
    raw.select("event_id", at.alias("ts"), "user_id", "event_type", "value", "props").repartition(2).write.parquet(f"{path}/events.parquet")
    return str(path)


def some():
    turns = [(c, t, ("user", "assistant")[t % 2], f"please fix the bug {c} {t}") for c in range(31) for t in range(2 + c % 4)]
    kinds = ["view", "purchase", "signup", "click", "error"]
    events = [(e, 60 * e, e % 31, kinds[e * 7 % 5], float(e * 13 % 50), "{}") for e in range(310)]
    return turns, events


def content(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_a_change_gives_what_a_fresh_build_gives(spark, tmp_path):
    turns, events = some()
    first = sources(spark, tmp_path / "a", turns, events)
    folder = str(tmp_path / "index")
    run = index.update(spark, first, folder)
    assert run.number == 1 and set(run.written) == set(index.TABLES) | {"files", "states"}
    assert index.update(spark, first, folder) is None
    # one session grows, one is gone but for its events, one is new below another's place, an event goes
    turns2 = [t for t in turns if t[0] != 7] + [(9, 9, "user", "write the tests too"), (20, 8, "user", "and now?")]
    second = sources(spark, tmp_path / "b", turns2, [e for e in events if e[0] != 100] + [(900, 90_000, 20, "purchase", 20.0, "{}")])
    run = index.update(spark, second, folder)
    fresh = str(tmp_path / "fresh")
    index.update(spark, second, fresh)
    kept, made = Store(spark, folder), Store(spark, fresh)
    for name in index.TABLES:
        assert content(kept.read(name)) == content(made.read(name)), name
    # what nothing reaches stays as the first run wrote it
    assert {r for (n, _), (r, _, _) in kept.manifest.items() if n == "sessions"} == {1, 2}
    assert 0 < run.written["accounted"] < kept.buckets
    # rows that only move to other files change nothing
    moved = sources(spark, tmp_path / "c", turns2, [e for e in events if e[0] != 100] + [(900, 90_000, 20, "purchase", 20.0, "{}")])
    run = index.update(spark, moved, folder)
    assert not {n for n in run.written} - {"files", "states"} and content(Store(spark, folder).read("outcomes")) == content(made.read("outcomes"))


KEYS = "sid long, v long"


def tiny(spark, rows, version="1", extra=None):
    df = spark.createDataFrame(rows, KEYS)
    double = lambda run, keys: upkeep.only(df.withColumn("v", 2 * F.col("v")), keys, "sid")
    total = lambda run, keys: upkeep.only(run.read("double").withColumn("v", F.col("v") + 1), keys, "sid")
    return {"double": Table(double), "plus": Table(extra or total, needs=("double",), version=version)}


def test_versions_gone_keys_and_failed_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.buckets = 4
    rows = [(k, k) for k in range(40)]
    upkeep.upkeep(store, None, tiny(spark, rows), None, {})
    values = lambda: {r["sid"]: r["v"] for r in Store(spark, str(tmp_path)).read("plus").collect()}
    assert values() == {k: 2 * k + 1 for k in range(40)}

    def fails(run, keys):
        raise RuntimeError("lost")

    change = spark.createDataFrame([(3,), (39,)], "sid long")
    later = [(k, k + (k == 3)) for k in range(39)]
    with pytest.raises(RuntimeError):
        upkeep.upkeep(Store(spark, str(tmp_path)), None, tiny(spark, later, extra=fails), change, {})
    assert values() == {k: 2 * k + 1 for k in range(40)}  # the old state, whole
    run = upkeep.upkeep(Store(spark, str(tmp_path)), None, tiny(spark, later), change, {})
    assert run.written["plus"] <= 2 and values() == {k: 2 * k + 1 + 2 * (k == 3) for k in range(39)}
    # another version of a classifier makes all of its own rows anew, and only those
    run = upkeep.upkeep(Store(spark, str(tmp_path)), None, tiny(spark, later, version="2"), change.limit(0), {})
    assert set(run.written) == {"plus"} and {v for (n, _), (_, _, v) in run.manifest.items() if n == "plus"} == {"2"}
    # no rows at all
    upkeep.upkeep(Store(spark, str(tmp_path)), None, tiny(spark, []), spark.range(39).select(F.col("id").alias("sid")), {})
    assert values() == {}


def test_file_changes(spark):
    kind = "path string, size long, modified_at long"
    a, b = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], kind), spark.createDataFrame([("b", 2, 2), ("c", 3, 4), ("d", 1, 1)], kind)
    assert {tuple(r) for r in upkeep.file_changes(b, a).collect()} == {("a", "gone"), ("c", "changed"), ("d", "new")}
    assert upkeep.buckets_for(0) == 8 and upkeep.buckets_for(10**14) > 1000 and upkeep.buckets_for(10**18) == upkeep.MOST_BUCKETS
    assert dataclasses.is_dataclass(Table)


def test_an_index_of_what_is_asked_for(spark):
    """Of the named table and what it needs alone, and of the same rows; a whole index was built for a query of one table."""
    from logloom.plans import views

    sf = "/root/testdata/sf0.001"
    store = upkeep.Store(spark, index.kept_up(spark, sf, "messages"))
    assert set(store.schemas) == {"messages", "edges", "files", "states"} and store.run == 2
    rows = lambda df: sorted(map(tuple, df.select("sid", "source_ordinal", "fingerprint").collect()))
    assert rows(store.read("messages")) == rows(views.messages(spark, sf))
    needs = upkeep.with_needs(index.TABLES, ["outcomes"])
    assert set(needs) == {"outcomes", "links", "commits", "sessions", "activity"}
