"""Which commits lie above which, over all parents of merges.

A history is cut into chains: of the commits that have the same first parent, the one with most commits below it
goes on with its parent's chain. Whoever is at a place of a chain has all places before it above them, so only
the links between chains are walked, and first parents change chain a logarithmic number of times. A commit's
time is taken as the latest of its own and of all above it, so times never rise on the way up: a link is walked
only if its far end is not older than what is looked for, and links are found by chain and day.

Commits and pairs are numbered first, so that rounds move numbers and no names; the tables of rounds go as they are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoints import Scratch, scratch, written

DAY = 86_400


def numbered(commits: DataFrame) -> DataFrame:
    """(name, node, own): a number for each commit and each parent, and the seconds of its latest time."""
    none = F.lit(None).cast("long")
    self_ = F.array(F.struct(F.col("commit_hash").alias("name"), F.unix_timestamp("committed_at").alias("own")))
    above = F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.struct(p.alias("name"), none.alias("own")))
    every = commits.select(F.explode(F.concat(self_, above)).alias("x")).select("x.*").where("name IS NOT NULL")
    return every.groupBy("name").agg(F.max("own").alias("own")).select("name", F.monotonically_increasing_id().alias("node"), "own")


def parent_links(commits: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, k, up) from commit_hash and parents (an array; the first parent first)."""
    named = commits.select(F.col("commit_hash").alias("name"), F.posexplode("parents").alias("k", "up_name")).where("up_name IS NOT NULL")
    return named.join(ids.select("name", "node"), "name").select("node", "k", "up_name").join(ids.select(F.col("name").alias("up_name"), F.col("node").alias("up")), "up_name").select("node", "k", "up").distinct()


def sizes(first: DataFrame, nodes: DataFrame, tables: Scratch) -> DataFrame:
    """(node, size): commits below each one over first parents, itself included; pointers double in reach."""
    now = tables.put("sizes", nodes.join(first, "node", "left").select("node", "up", F.lit(1).cast("long").alias("size")))
    while not now.where("up IS NOT NULL").isEmpty():
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        now = tables.put("sizes", now.join(below, "node", "left").join(ahead, "up", "left").select("node", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return now.select("node", "size")


def placed(links: DataFrame, numbers: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(places, heavy): node, chain, pos of each commit; and the links (node, up) inside chains.

    Over checkpoints instead of tables, the plan's time doubled with each round of the second loop."""
    first = tables.put("first", links.where("k = 0").groupBy("node").agg(F.min("up").alias("up")))
    best = first.join(sizes(first, numbers, tables), "node").groupBy("up").agg(F.max_by("node", F.struct("size", "node")).alias("node"))
    heavy = tables.put("heavy", best.select("node", "up"))
    tables.drop("first", "sizes")
    now = tables.put("places", numbers.join(heavy, "node", "left").select("node", F.coalesce("up", "node").alias("chain"), F.col("up").isNotNull().cast("long").alias("pos")))
    before = -1
    while True:
        reach = now.agg(F.sum("pos")).first()[0]
        if reach == before:
            return now, heavy
        before = reach
        ahead = now.select(F.col("node").alias("chain"), F.col("chain").alias("next"), F.col("pos").alias("more"))
        now = tables.put("places", now.join(ahead, "chain").select("node", F.col("next").alias("chain"), (F.col("pos") + F.col("more")).alias("pos")))


def with_times(places: DataFrame, across: DataFrame, ids: DataFrame, tables: Scratch) -> DataFrame:
    """places with at: seconds of the latest time of a commit and all above it.

    One round where clocks agree; one more for each link on a way along which they don't."""
    along = W.partitionBy("chain").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    now = places.join(ids.select("node", "own"), "node").withColumn("at", F.coalesce(F.max("own").over(along), F.lit(0)))
    while True:
        now = tables.put("times", now.select("node", "chain", "pos", "at"))
        late = across.join(now.select("node", F.col("at").alias("node_at")), "node").join(now.select(F.col("node").alias("up"), F.col("at").alias("up_at")), "up").where("up_at > node_at")
        late = tables.put("late", late.groupBy("node").agg(F.max("up_at").alias("up_at")))
        if late.isEmpty():
            return now
        now = now.join(late, "node", "left").withColumn("at", F.max(F.greatest("at", "up_at")).over(along))


def descends(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_hash, ancestor) of the pairs whose commit has the (possibly shortened) ancestor above it, over any parents.

    commits: commit_hash, parents (array), committed_at. A parent that isn't in commits is known as what it is, but
    nothing above it. Ancestors of under seven characters are never found."""
    with scratch(commits.sparkSession) as tables:
        return written(_descends(pairs, commits, tables))


def _descends(pairs: DataFrame, commits: DataFrame, tables: Scratch) -> DataFrame:
    ids = tables.put("ids", numbered(commits))
    links = tables.put("links", parent_links(commits, ids))
    asked = pairs.where("length(ancestor) >= 7").select("commit_hash", "ancestor").distinct()
    asked = tables.put("asked", asked.withColumn("pair", F.monotonically_increasing_id()))
    places, heavy = placed(links, ids.select("node"), tables)
    across = tables.put("across", links.select("node", "up").distinct().join(heavy, ["node", "up"], "left_anti"))
    at = with_times(places, across, ids, tables)
    ends = lambda side, *names: at.select(F.col("node").alias(side), *[F.col(c).alias(n) for c, n in zip(("chain", "pos", "at"), names, strict=True)])
    roads = across.join(ends("node", "chain", "from_pos", "from_at"), "node").join(ends("up", "to_chain", "to_pos", "to_at"), "up")
    roads = tables.put("roads", roads.select("chain", F.floor(F.col("from_at") / DAY).alias("day"), "from_pos", "to_chain", "to_pos", "to_at"))
    tables.drop("across", "heavy", "places", "late")
    short = asked.select("pair", "ancestor", F.substring("ancestor", 1, 7).alias("short"))
    tops = short.join(ids.select("name", F.col("node").alias("top"), F.substring("name", 1, 7).alias("short")), "short").where(F.col("name").startswith(F.col("ancestor"))).select("pair", "top")
    goals = tops.join(ends("top", "top_chain", "top_pos", "top_at"), "top").drop("top")
    own = ["pair", "top_chain", "top_pos", "top_at"]
    begin = asked.select("pair", F.col("commit_hash").alias("name")).join(ids.select("name", "node"), "name").select("pair", "node").join(links.select("node", "up"), "node")
    start = goals.join(begin.select("pair", "up").distinct(), "pair").join(ends("up", "chain", "pos", "at"), "up").where("at >= top_at")
    front = tables.put("front", start.groupBy(*own, "chain").agg(F.max("pos").alias("pos"), F.max("at").alias("at")))
    tables.drop("ids", "links", "times")
    seen, found = front, None
    hit = (F.col("chain") == F.col("top_chain")) & (F.col("pos") >= F.col("top_pos"))
    while True:
        new = front.where(hit).select("pair")
        found = tables.put("found", (new if found is None else found.union(new)).distinct())
        days = F.explode(F.sequence(F.floor(F.col("top_at") / DAY), F.floor(F.col("at") / DAY)))
        ahead = front.join(found, "pair", "left_anti").select(*own, "chain", "pos", days.alias("day"))
        ahead = ahead.join(roads, ["chain", "day"]).where("from_pos <= pos AND to_at >= top_at")
        ahead = ahead.groupBy(*own, F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("pos"), F.max("to_at").alias("at"))
        was = seen.groupBy(*own, "chain").agg(F.max("pos").alias("was"))
        new = ahead.join(was, [*own, "chain"], "left").where("was IS NULL OR pos > was").select(*own, "chain", "pos", "at")
        if seen is front:  # the first round's front is all that was seen
            seen = tables.put("seen", seen)
        front = tables.put("front", new)
        if front.isEmpty():
            return asked.join(found, "pair").select("commit_hash", "ancestor")
        seen = tables.put("seen", seen.unionByName(front).groupBy(*own, "chain").agg(F.max("pos").alias("pos"), F.max("at").alias("at")))
