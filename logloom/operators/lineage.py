"""Spawn graphs and token lineage: which part of a child session's cumulative counters its parent already had.

Edges are (parent, child); a session that is the child of several edges has no usable parent. Evidence is
exact: runs of equal cumulative vectors, in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoints import checkpointed
from logloom.functions import vectors as V
from logloom.operators import graphs


def single_parent(edges: DataFrame) -> DataFrame:
    """Edges of the children that have one parent."""
    return edges.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("parent")).where("n = 1").select("parent", "child")


def ancestry(edges: DataFrame) -> DataFrame:
    """(node, depth, cyclic, on_cycle) of every node of edges, whatever number of parents they have.

    depth: the longest way from a node without parents over nodes that are on no cycle, null where none leads to
    it; cyclic: on or below a cycle."""
    e = checkpointed(edges.select("parent", "child").distinct())
    ways = graphs.climbed(e)
    on = graphs.cyclic(e, ways)
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
    below = on if on.isEmpty() else descendants(e, on.select(F.col("node").alias("sid"))).select(F.col("sid").alias("node"))
    marks = below.select("node", F.lit(True).alias("cyclic")), on.select("node", F.lit(True).alias("on_cycle"))
    found = nodes.join(graphs.depths(e, on, ways), "node", "left").join(marks[0], "node", "left").join(marks[1], "node", "left")
    return found.select("node", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def in_cycles(edges: DataFrame, above: DataFrame) -> DataFrame:
    """edges with cyclic: true where an end is on a cycle, else null."""
    on = above.where("on_cycle").select(F.col("node"), F.lit(True).alias("cyclic"))
    ends = [on.select(F.col("node").alias(c), F.col("cyclic").alias(f"{c}_cyclic")) for c in ("child", "parent")]
    return edges.join(ends[0], "child", "left").join(ends[1], "parent", "left").select(*edges.columns, F.coalesce("child_cyclic", "parent_cyclic").alias("cyclic"))


def topology(session_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sessions, roots, edges, valid edges (both ends known) and their children, orphan parents and orphan children apart, self edges,
    children of several parents, nodes on cycles, the greatest depth and the trees of several generations.

    Depth and cycles are those of the valid edges; a way may end on a cycle, but does not go on from there."""
    ids = session_ids.select("sid").distinct().withColumn("known", F.lit(1))
    both = edges.join(ids.select(F.col("sid").alias("parent"), F.col("known").alias("p")), "parent", "left").join(ids.select(F.col("sid").alias("child"), F.col("known").alias("c")), "child", "left")
    fine = F.col("p").isNotNull() & F.col("c").isNotNull()
    e = both.agg(
        F.count("*").alias("edges"),
        F.count_if(fine).alias("valid_edges"),
        F.count_distinct(F.when(fine, F.col("child"))).alias("children"),
        F.count_if(F.col("p").isNull()).alias("orphan_parents"),
        F.count_if(F.col("c").isNull()).alias("orphan_children"),
        F.count_if(F.col("parent") == F.col("child")).alias("self_edges"),
    )
    valid = checkpointed(both.where(fine).select("parent", "child").distinct())
    several = valid.groupBy("child").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("several_parents"))
    above = checkpointed(ancestry(valid))
    sound = above.where("NOT on_cycle AND depth IS NOT NULL").select(F.col("node").alias("parent"), "depth")
    into = valid.join(sound, "parent").agg(F.max("depth").alias("d")).select(F.coalesce(F.col("d") + 1, F.lit(0)).alias("depth"))
    up = above.agg(F.count_if("on_cycle").alias("cycle_nodes"))
    first = valid.join(sound.where("depth = 0"), "parent").select(F.col("parent").alias("root"), F.col("child").alias("parent")).join(sound.select("parent"), "parent")
    trees = first.join(valid.select("parent"), "parent", "left_semi").agg(F.count_distinct("root").alias("multi_generation_trees"))
    n = ids.join(valid.select(F.col("child").alias("sid"), F.lit(1).alias("spawned")).distinct(), "sid", "left").agg(F.count("*").alias("sessions"), F.count_if(F.col("spawned").isNull()).alias("roots"))
    for row in (e, several, up, into, trees):
        n = n.crossJoin(row)  # one row each
    return n


def descendants(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(sid): the changed sessions and all below them.

    Below children of one parent pointers double in reach each round, so rounds follow the logarithm of the
    depth; what lies below a child of several parents takes another such turn. A round that finds nothing ends
    a turn, as what is found has no gaps, and so cycles end too."""
    e = checkpointed(edges.select("parent", "child").where("parent <> child").distinct())
    several = checkpointed(e.join(e.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select("child"), "child", "left_semi"))
    forest = e.join(several, "child", "left_anti").select(F.col("child").alias("node"), F.col("parent").alias("up"))
    found = checkpointed(changed.select("sid").distinct())
    n = found.count()
    while True:
        up, before = checkpointed(forest), -1
        while before != n:
            before = n
            found = checkpointed(found.union(up.join(found, up.up == found.sid).select(F.col("node").alias("sid"))).distinct())
            n = found.count()
            up = checkpointed(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        found = checkpointed(found.union(several.join(found, several.parent == found.sid).select(F.col("child").alias("sid"))).distinct())
        if found.count() == n:
            return found
        n = found.count()


def longest_prefix(parent: list[int], child: list[int]) -> tuple[int, int]:
    """(start, matched): the longest run of parent equal to the beginning of child, the earliest of equals.

    Runs at each place are told from those before it, so that every row is looked at a bounded number of times."""
    both = [*child, -1, *parent]
    n, m = len(both), len(child)
    run = [0] * n
    left = right = best = start = 0
    for i in range(1, n):
        k = min(run[i - left], right - i) if i < right else 0
        while i + k < n and both[k] == both[i + k]:
            k += 1
        run[i] = k
        if i + k > right:
            left, right = i, i + k
        if i > m and k > best:
            best, start = k, i - m - 1
    return start, best


def prefix_runs(parent: DataFrame, child: DataFrame, by: list[str]) -> DataFrame:
    """For each group: the longest run of parent rows equal to the child's first ones (the earliest of equals).

    Both have the columns by, i (0, 1, ... within the group) and key. Returns by, start, matched. Only groups whose
    first child key the parent has are looked at; a group is one edge, whatever number of places a run may start at."""
    first = child.where("i = 0").select(*by, "key")
    live = parent.join(first, [*by, "key"], "left_semi").select(*by).distinct()
    kinds = ", ".join(f"{c} {child.schema[c].dataType.simpleString()}" for c in by)

    def runs(key: tuple[pa.Scalar, ...], p: pa.Table, c: pa.Table) -> pa.Table:
        p, c = p.sort_by("i"), c.sort_by("i")
        codes = pa.concat_arrays([*c["key"].chunks, *p["key"].chunks]).dictionary_encode().indices.to_pylist() if len(p) and len(c) else []
        start, matched = longest_prefix(codes[len(c) :], codes[: len(c)]) if codes else (0, 0)
        n = 1 if matched else 0
        return pa.table({**{b: pa.array([k.as_py()] * n, k.type) for b, k in zip(by, key, strict=True)}, "start": pa.array([start] * n, pa.int64()), "matched": pa.array([matched] * n, pa.int64())})

    def some(df: DataFrame) -> DataFrame:
        return df.select(*by, F.col("i").cast("long").alias("i"), "key").join(live, by, "left_semi").select(*[F.col(c).alias(c) for c in (*by, "i", "key")])

    return some(parent).groupBy(*by).cogroup(some(child).groupBy(*by)).applyInArrow(runs, f"{kinds}, start long, matched long")


def edge_verdicts(events: DataFrame, edges: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(parent, child, status, confidence, evidence, matched, baseline, incremental, deltas) of each edge.

    events: sid, event_ordinal, cumulative (vector), and delta (vector) if there is one. Rules in order:
    cycle; no child snapshots; no parent snapshots; a run of two at least; the child's first equal to the
    parent's last; an explicit zero first. A rule whose difference would be negative gives way to the next."""
    if "delta" not in events.columns:
        events = events.withColumn("delta", F.lit(None).cast(V.TYPE))
    order = W.partitionBy("sid").orderBy("event_ordinal")
    snaps = events.where("cumulative IS NOT NULL").withColumn("i", F.row_number().over(order) - 1).withColumn("key", V.key(F.col("cumulative")))
    e = single_parent(edges)
    e = in_cycles(e, ancestry(edges) if above is None else above)
    p = e.where("cyclic IS NULL").join(snaps, e.parent == snaps.sid).select("parent", "child", "i", "key", "cumulative")
    c = e.where("cyclic IS NULL").join(snaps, e.child == snaps.sid).select("parent", "child", "i", "key", "cumulative", "delta")
    runs = prefix_runs(p.select("parent", "child", "i", "key"), c.select("parent", "child", "i", "key"), ["parent", "child"])
    ends = c.groupBy("parent", "child").agg(F.min_by("cumulative", "i").alias("first"), F.max_by("cumulative", "i").alias("last"), F.count("*").alias("n"))
    tops = p.groupBy("parent", "child").agg(F.max_by("cumulative", "i").alias("top"))
    at = p.select("parent", "child", F.col("i").alias("j"), F.col("cumulative").alias("run_end"))
    runs = runs.withColumn("j", F.col("start") + F.col("matched") - 1).join(at, ["parent", "child", "j"]).drop("j")
    rows = e.join(ends, ["parent", "child"], "left").join(tops, ["parent", "child"], "left").join(runs, ["parent", "child"], "left")
    first, last, top, run_end = map(F.col, ("first", "last", "top", "run_end"))
    by_run = (F.col("matched") >= 2) & ~V.decreases(last, run_end)
    by_end = V.same(first, top) & ~V.decreases(last, first)
    rule = (
        F.when(F.col("cyclic"), 0)
        .when(F.col("n").isNull(), 1)
        .when(top.isNull(), 2)
        .when(by_run, 3)
        .when(by_end, 4)
        .when(V.explicit_zero(first), 5)
        .otherwise(6)
    )
    rows = rows.withColumn("rule", rule)

    def pick(*values: object) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)

    baseline = F.when(F.col("rule") == 3, run_end).when(F.col("rule").isin(4, 5), first)
    incremental = F.when(F.col("rule") == 3, V.subtract(last, run_end)).when(F.col("rule") == 4, V.subtract(last, first)).when(F.col("rule") == 5, last)
    skipped = F.when(F.col("rule") == 3, F.col("matched")).when(F.col("rule").isin(4, 5), F.lit(1))
    rows = rows.select("parent", "child", "rule", "start", skipped.cast("long").alias("matched"), baseline.alias("baseline"), incremental.alias("incremental"))
    after = rows.where("matched IS NOT NULL").join(c, ["parent", "child"]).where("i >= matched").groupBy("parent", "child").agg(V.total(lambda f: F.col("delta")[f]).alias("sum"), F.count_if(F.col("delta").isNull()).alias("missing"))
    deltas = F.when(F.col("matched").isNull() | F.col("missing").isNull() | (F.col("missing") > 0), "unavailable").when(V.same(F.col("sum"), F.col("incremental")), "exact").otherwise("mismatch")
    return rows.join(after, ["parent", "child"], "left").select(
        "parent",
        "child",
        pick("cycle", "unavailable", "ambiguous", "inherited_prefix", "inherited_exact", "independent", "ambiguous").alias("status"),
        pick("none", "none", "none", "high", "high", "explicit", "none").alias("confidence"),
        pick("cyclic_spawn_graph", "child_token_data_unavailable", "parent_token_data_unavailable", "exact_cumulative_vector_prefix", "child_initial_equals_parent_final", "explicit_zero_cumulative_baseline", "no_exact_ancestor_baseline").alias("evidence"),
        "matched",
        "baseline",
        "incremental",
        deltas.alias("deltas"),
    )


def accounted(usage: DataFrame, verdicts: DataFrame) -> DataFrame:
    """usage (sid, semantics, observed) with the vector to add up: a child's increment where inheritance is exact, else what was observed."""
    v = verdicts.select(F.col("child").alias("sid"), "status", "baseline", "incremental")
    inherited = F.col("status").isin("inherited_prefix", "inherited_exact")
    return usage.join(v, "sid", "left").select("sid", "semantics", "observed", F.coalesce("status", F.lit("root")).alias("lineage"), F.when(inherited, F.col("baseline")).alias("baseline"), F.when(inherited, F.col("incremental")).otherwise(F.col("observed")).alias("accounted"))
