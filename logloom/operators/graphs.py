"""Directed graphs with any number of parents: cycles, depths, and which node lies above which.

Nodes of one parent are climbed by pointers that double in reach each round, so rounds follow the logarithm of
the depth. Only what several parents meet in is left to walk: a graph of those nodes alone, whose rounds follow
the number of such nodes on a path. Every round ends in a checkpoint; nothing is collected but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import checkpointed


def climbed(edges: DataFrame) -> DataFrame:
    """(node, top, dist, open) of distinct edges (parent, child): each node's way up to the first node that has not just one parent.

    dist: edges on the way. open: the way never ends, as it leads into a cycle of nodes of one parent each; top
    then is a node of that cycle, and the tops of open nodes are all of it."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    parents = edges.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("parent")).where("n = 1")
    ups = nodes.join(parents.select(F.col("child").alias("node"), "parent"), "node", "left")
    now = checkpointed(ups.select("node", F.coalesce("parent", "node").alias("top"), F.col("parent").isNotNull().cast("long").alias("dist"), F.col("parent").isNotNull().alias("open")))
    before: tuple[int, ...] = (-1, -1)
    while True:
        left = now.where("open").agg(F.count("*"), F.count_distinct("top")).first()
        if not left[0] or tuple(left) == before:
            return now
        before = tuple(left)
        ahead = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("dist").alias("more"), F.col("open").alias("on"))
        now = checkpointed(now.join(ahead, "top").select("node", F.col("next").alias("top"), (F.col("dist") + F.col("more")).alias("dist"), (F.col("open") & F.col("on")).alias("open")))


def junctions(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """(a, b, via, w): from the top of each parent of a node of several parents to that node; via: the parent; w: edges on the way. Ways that never end are left out."""
    several = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select("child")
    into = edges.join(several, "child")
    return into.join(ways.where("NOT open").select(F.col("node").alias("parent"), "top", "dist"), "parent").select(F.col("top").alias("a"), F.col("child").alias("b"), F.col("parent").alias("via"), (F.col("dist") + 1).alias("w"))


def strong(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) on a cycle; the component is one of its nodes.

    Nodes without an edge in or out are trimmed, again and again. In what is left each node takes the greatest node
    that leads to it as its colour; what leads back to that node within its colour is a component, and goes."""
    left = checkpointed(edges.select("a", "b").distinct())
    found = None
    while True:
        n = left.count()
        while n:
            left = checkpointed(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            m = left.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = checkpointed(left.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = left.join(colour.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("near"))
            now = checkpointed(colour.join(near, "node", "left").select("node", F.col("colour").alias("was"), F.greatest("colour", F.coalesce("near", "colour")).alias("colour")))
            colour = now.select("node", "colour")
            if now.where("was <> colour").isEmpty():
                break
        same = left.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("component")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("component")), ["b", "component"])
        same = checkpointed(same.select("a", "b", "component"))
        back = checkpointed(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        m = back.count()
        while True:
            more = same.join(back.select(F.col("node").alias("b"), "component"), ["b", "component"]).select(F.col("a").alias("node"), "component")
            back = checkpointed(back.union(more).distinct())
            k = back.count()
            if k == m:
                break
            m = k
        # a node alone is on a cycle only by an edge to itself
        sizes = back.groupBy("component").agg(F.count("*").alias("n"))
        loops = left.where("a = b").select(F.col("a").alias("node"), F.lit(True).alias("loop"))
        cyclic = checkpointed(back.join(sizes, "component").join(loops, "node", "left").where("n > 1 OR loop").select("node", "component"))
        found = cyclic if found is None else found.unionByName(cyclic)
        gone = back.select("node")
        left = checkpointed(left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    kind = edges.schema["a"].dataType
    return edges.sparkSession.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind)) if found is None else checkpointed(found)


def cyclic(edges: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """(node) of the nodes on a cycle of (parent, child)."""
    edges = edges.select("parent", "child").distinct()
    ways = climbed(edges) if ways is None else ways
    plain = ways.where("open").select(F.col("top").alias("node")).distinct()
    joints = checkpointed(junctions(edges, ways))
    if joints.isEmpty():
        return checkpointed(plain)
    parts = strong(joints)
    ends = joints.join(parts.select(F.col("node").alias("a"), "component"), "a").join(parts.select(F.col("node").alias("b"), "component"), ["b", "component"])
    # between two junctions of a component: from the parent by which the way comes in, up to the junction
    marked = checkpointed(ends.select(F.col("via").alias("node")).union(parts.select("node")).distinct())
    if marked.isEmpty():
        return checkpointed(plain)
    single = edges.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("up")).where("n = 1").select(F.col("child").alias("node"), "up")
    up, n, before = checkpointed(single), marked.count(), -1
    while n != before:
        before = n
        marked = checkpointed(marked.union(up.join(marked, "node", "left_semi").select(F.col("up").alias("node"))).distinct())
        n = marked.count()
        up = checkpointed(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
    # a way that leaves a component above its junction isn't part of it: those end at a junction of the component
    return checkpointed(plain.union(marked).distinct())


def depths(edges: DataFrame, on_cycle: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """(node, depth): the longest way from a node without parents, over nodes that are on no cycle; nodes that none leads to aren't there.

    ways: climbed() of the edges, which serves where no node is on a cycle."""
    edges = edges.select("parent", "child").distinct()
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    roots = nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    free = edges
    if ways is None or not on_cycle.isEmpty():
        free = edges.join(on_cycle.select(F.col("node").alias("parent")), "parent", "left_anti").join(on_cycle.select(F.col("node").alias("child")), "child", "left_anti")
        free = checkpointed(free.select("parent", "child"))
        ways = climbed(free)
    steps = checkpointed(junctions(free, ways).groupBy("a", "b").agg(F.max("w").alias("w")))
    tops = checkpointed(roots.withColumn("depth", F.lit(0).cast("long")))
    while not steps.isEmpty():
        longer = steps.join(tops, steps.a == tops.node).groupBy(F.col("b").alias("node")).agg(F.max(F.col("depth") + F.col("w")).alias("depth"))
        now = checkpointed(tops.unionByName(longer).groupBy("node").agg(F.max("depth").alias("depth")))
        if now.exceptAll(tops).isEmpty():
            break
        tops = now
    down = ways.join(tops.select(F.col("node").alias("top"), "depth"), "top").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    return down.union(tops).groupBy("node").agg(F.max("depth").alias("depth"))
