"""Near-duplicates by exact Jaccard similarity of word shingles, with MinHash candidates.

Equal sets of shingles are one node. A node's MinHash values are cut into bands; nodes that agree in a whole
band are candidates, and a candidate pair is a link where the sets' exact similarity reaches the threshold.

The nodes of a band that more than ``full`` share aren't compared pair by pair. Sets that reach the threshold share
one of the rarest of their shingles (of n, all but as many as the threshold demands in common, and one), so such nodes
meet by these (prefixes), and every pair that a crowded band has is found; texts that only have a long passage in
common don't meet, as its shingles are the frequent ones.

A shingle that more than ``full`` of them have among their rarest is a crowd. Only components are asked for, so
nodes that are known to be of one component are never compared. Of each crowd the component of most nodes
stays aside; the nodes outside it are hubs in turn, a few of a crowd each round, and a hub is compared with the
nodes of its crowd that are of other components. Rounds go on until each node outside was a hub, so the components
are those of all pairs of the crowd; copies of one text are settled by one hub.

Before a set is moved to another, their sizes and parity maps are: a map holds the parity of the number of
shingles that fall on each of its bits (two bits a shingle at least), and two maps differ in no more bits than
their sets in shingles, so a pair that the bound keeps below the threshold is none. That moves a thirtieth of a
set, and sets only for pairs that are links or nearly so.

A pair at the threshold of 0.8 meets in one of 20 bands of 5 values but for 0.04 % of the cases.

Nodes whose SimHash fingerprints (simhash, as op8 makes them) differ in two bits at most are candidates too: the
pipeline's near-duplicate stage goes by SimHash, with this exact check behind it, and takes from MinHash what
two bits can't tell, as fingerprints differ in about ten of 64 bits at the threshold.

Defined cases: a null text is like an empty one (the empty set; all of those are one class); a document of
fewer words than a shingle is one shingle; rows are told apart by their id and text, so that rows that
repeat an id with another text are documents of their own, and rows alike in both are copies; rows without
an id are documents too, and stay only where no other of their class has one; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoints import Scratch, scratch, swept

from . import meetings, simhash
from .common import checkpointed, released
from .components import components
from .repeats import MIX, mixed
from .simhash import LOWER

BLOCK = 1 << 10  # shingles under all hashes at once
LEAST_BITS = 512  # of a parity map
MOST_HUBS, MOST_ROWS = 256, 4096  # of a crowd, that meet in one task at once


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, 42) for x in (text or "").encode().translate(LOWER).split()], "u8")
    if not len(w):
        return w
    size = min(words, len(w))
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * MIX + w[k : k + len(h)]
    return np.unique(mixed(h + np.uint64(size)))


def bands(s: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of the set's MinHash values."""
    least = np.full(len(factors), 2**64 - 1, "u8")
    for lo in range(0, len(s), BLOCK):
        np.minimum(least, (s[lo : lo + BLOCK, None] * factors).min(0), out=least)
    least = mixed(least).reshape(-1, rows)
    key = np.arange(len(least), dtype="u8")
    for k in range(rows):
        key = mixed(key * MIX + least[:, k])
    return key.view("i8")


def signatures(text: Column, words: int, n: int, rows: int) -> Column:
    """struct<digest binary, keys array<long>>: the set's 128-bit digest and its bands."""
    factors = np.random.default_rng(42).integers(0, 2**63, n * rows, "u8") * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        released()
        for b in batches:
            digests, keys = [], []
            for t in b.to_pylist():
                s = shingles(t, words)
                digests.append(xxhash.xxh128_digest(s.tobytes()))
                keys.append(bands(s, factors, rows))
            flat = pa.array(np.concatenate([np.zeros(0, "i8"), *keys]), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * n, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(digests, pa.binary()), lists], ["digest", "keys"])

    return F.arrow_udf(run, "struct<digest: binary, keys: array<long>>")(text)


def sets(text: Column, words: int) -> Column:
    """struct<s, map>: the set and its parity map as bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [shingles(t, words) for t in b.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array([parity(x) for x in found], pa.binary())], ["s", "map"])

    return F.arrow_udf(run, "struct<s: binary, map: binary>")(text)


def parity(s: np.ndarray) -> bytes:
    """For each bit, whether the number of hashes that fall on it is odd."""
    bits = max(LEAST_BITS, 1 << (2 * len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """The bits in which two parity maps differ, at the size of the smaller."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_reach(a: Column, b: Column, both: Column, threshold: float) -> Column:
    """Whether the maps leave a similarity of the threshold possible. both: the number of shingles of the two."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys, ns in batches:
            out = []
            for x, y, n in zip(xs, ys, ns.to_pylist(), strict=True):
                d = differing(*(np.frombuffer(v.as_py(), "u1") for v in (x, y)))
                out.append(n - d >= threshold * (n + d) - 1e-9)
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(a, b, both)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets as bytes; two empty ones are alike."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            out = []
            for x, y in zip(xs, ys, strict=True):
                x, y = (np.frombuffer(v.as_py(), "u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def linked(pairs: DataFrame, used: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the distinct pairs of nodes whose sets are alike. used: node, s; maps: node, n (its shingles), map."""
    x, y = (maps.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("map").alias(f"map_{k}")) for k in "ab")
    long = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    near = pairs.join(x, "a").join(y, "b").where(long).where(may_reach(F.col("map_a"), F.col("map_b"), F.col("n_a") + F.col("n_b"), threshold))
    return alike(checkpointed(near.select("a", "b")), used, threshold)


def alike(near: DataFrame, used: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike. used: node, s."""
    x, y = (used.select(F.col("node").alias(k), F.col("s").alias(f"s_{k}")) for k in "ab")
    return checkpointed(near.join(x, "a").join(y, "b").where(similarity(F.col("s_a"), F.col("s_b")) >= threshold).select("a", "b"))


def items(s: Column) -> Column:
    """The shingles of a set as bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [np.frombuffer(v.as_py(), "i8") for v in b]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "i8"), *found]), pa.int64()))

    return F.arrow_udf(run, "array<long>")(s)


def prefixes(used: DataFrame, threshold: float) -> DataFrame:
    """(node, key): of each set (node, s) the rarest shingles, of which two sets share one if their similarity reaches the threshold; those of one set alone are left out."""
    rows = checkpointed(used.select("node", (F.octet_length("s") / 8).cast("long").alias("n"), F.explode(items(F.col("s"))).alias("key")))
    counts = rows.groupBy("key").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("node").orderBy("df", "key"))
    rarest = rows.join(counts, "key").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    return rarest.where("df > 1").select("node", "key")


def meeting(rows: DataFrame, full: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowd): distinct pairs a < b of the nodes that share a key (node, key) of few; and key, node of the keys of more."""
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(rows.join(groups, "key"))
    few = shared.where(F.col("n") <= full).groupBy("key").agg(F.collect_list("node").alias("g"))
    pairs = F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(least(x, y) AS a, greatest(x, y) AS b))))")
    return few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), shared.where(F.col("n") > full).select("key", "node")


def met_maps(threshold: float) -> Callable[[tuple[pa.Scalar, ...], pa.Table, pa.Table], pa.Table]:
    """(hub, node) of other components whose sizes and maps leave a similarity of the threshold possible, as matrices."""

    def run(key: tuple[pa.Scalar, ...], hubs: pa.Table, rows: pa.Table) -> pa.Table:
        maps, sizes, labels = rows["map"].to_pylist(), np.array(rows["n"].to_pylist(), "f8"), np.array([*rows["label"].to_pylist(), None], object)[:-1]
        lengths, folded = np.array([len(m) for m in maps]), {}
        places = {x: np.flatnonzero(lengths == x) for x in set(lengths.tolist())}
        left, right = [], []
        for i, (m, n, own) in enumerate(zip(hubs["map"].to_pylist(), hubs["n"].to_pylist(), hubs["own"].to_pylist(), strict=True)):
            for length, at in places.items():
                h, size = np.frombuffer(m, "u1"), min(length, len(m))
                while len(h) > size:
                    h = h[: len(h) // 2] ^ h[len(h) // 2 :]
                if (length, size) not in folded:
                    x = np.frombuffer(b"".join(maps[k] for k in at), "u1").reshape(len(at), length)
                    while x.shape[1] > size:
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    folded[length, size] = x
                d, both = np.bitwise_count(folded[length, size] ^ h).sum(1, dtype="i8"), n + sizes[at]
                near = (both - d >= threshold * (both + d) - 1e-9) & (np.minimum(n, sizes[at]) >= threshold * np.maximum(n, sizes[at]) - 1e-9)
                found = [k for k in at[near] if labels[k] != own]
                left += [i] * len(found)
                right += found
        return pa.table({"hub": hubs["hub"].take(pa.array(left, pa.int64())), "node": rows["node"].take(pa.array(right, pa.int64()))})

    return run


def crowd_links(crowd: DataFrame, used: DataFrame, maps: DataFrame, known: DataFrame, threshold: float, hubs: int, tables: Scratch | None = None) -> DataFrame:
    """(a, b): known, and links that connect with them what all pairs of each crowd (key, node) would connect.

    A hub's map meets those of its crowd in blocks of bounded size, and only pairs that may be links become rows. The
    first hub of a crowd is the node of most crowds: of near copies one that is like most of them."""
    if crowd.isEmpty():
        return known
    tables = tables or Scratch(used.sparkSession)
    links, lots, was_hub, rounds = known, 1, None, 0
    weights = crowd.groupBy("node").agg(F.count("*").alias("crowds"))
    nodes = checkpointed(weights.join(maps.select("node", "n", "map"), "node"))
    labels = tables.put("labels", nodes.select("node").join(components(known), "node", "left").select("node", F.coalesce("component", "node").alias("label")))
    kind = nodes.schema["node"].dataType.simpleString()
    while True:
        state = checkpointed(crowd.join(nodes.join(labels, "node"), "node"))
        left = state if was_hub is None else checkpointed(state.join(was_hub, ["key", "node"], "left_anti"))
        outside = left
        if was_hub is not None:
            most = state.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "label")).alias("m")).select("key", F.col("m.label").alias("main"))
            outside = left.join(most, "key").where("label <> main")
        # the same nodes in all crowds as far as may be, so that crowds have pairs in common
        lot = F.pmod(F.xxhash64("node"), F.lit(lots)).alias("lot")
        chosen = outside.groupBy("key", lot).agg(F.min(F.struct(F.negative("crowds").alias("crowds"), "node", "label", "n", "map")).alias("h"))
        chosen = checkpointed(chosen.select("key", F.col("h.node").alias("hub"), F.col("h.label").alias("own"), "h.n", "h.map"))
        if chosen.isEmpty():
            return links
        met = meetings.met(chosen.withColumn("row", F.col("hub")), left.select("key", "node", "label", "n", "map", F.col("node").alias("row")), ["key"], met_maps(threshold), f"hub {kind}, node {kind}", MOST_HUBS, MOST_ROWS)
        near = checkpointed(met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
        found = alike(near, used, threshold)
        hub = chosen.select("key", F.col("hub").alias("node"))
        was_hub = hub if was_hub is None else was_hub.unionByName(hub)
        lots = min(16 * lots, hubs)
        swept(used.sparkSession)
        rounds += 1
        if not found.isEmpty():
            found = tables.put(f"found{rounds}", found)
            links = links.unionByName(found)
            x, y = (labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
            merged = components(found.join(x, "a").join(y, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
            labels = tables.put("labels", labels.join(merged.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("label")))


def row_names(key: str, text: str) -> list[Column]:
    """a and b: hashes that name a row by its key and text."""
    return [F.xxhash64(key, text).alias("a"), F.xxhash64(F.lit("row"), text, key).alias("b")]


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes (node, fp) that SimHash brings together: each with the least of its fingerprint, and those of fingerprints that differ in two bits at most."""
    reps = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    same = nodes.join(reps.where("n > 1"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.linked(reps.select("fp", F.col("least").alias("node"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.union(near).distinct()


def classes(docs: DataFrame, key: str, text: str, words: int, threshold: float, n: int, rows: int, full: int = 32, hubs: int = 256) -> tuple[DataFrame, DataFrame]:
    """(signed, found): each row's k (the key), a, b and node (its set's digest); and the component of the nodes that have links."""
    signed = checkpointed(docs.select(F.col(key).alias("k"), *row_names(key, text), signatures(F.col(text), words, n, rows).alias("s"), simhash.fingerprints(F.col(text)).alias("fp")).select("k", "a", "b", F.col("s.digest").alias("node"), "s.keys", "fp"))
    nodes = checkpointed(signed.groupBy("node").agg(F.first("keys").alias("keys"), F.min("a").alias("a"), F.min("fp").alias("fp")))
    pairs, crowd = map(checkpointed, meeting(nodes.select("node", F.explode("keys").alias("key")), full))
    pairs = checkpointed(pairs.union(near_fingerprints(nodes.select("node", "fp"))).distinct())
    swept(docs.sparkSession)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct().join(nodes.select("node", "a"), "node")
    # a node's set comes from one row of it
    texts = docs.select(row_names(key, text)[0], F.col(text).alias("t")).join(asked, "a").dropDuplicates(["node"])
    used = checkpointed(texts.select("node", sets(F.col("t"), words).alias("x")).select("node", "x.s", "x.map"))
    maps = checkpointed(used.select("node", (F.octet_length("s") / 8).cast("long").alias("n"), "map"))
    few, crowd = map(checkpointed, meeting(prefixes(used.join(crowd.select("node").distinct(), "node", "left_semi"), threshold), full))
    swept(docs.sparkSession)
    with scratch(docs.sparkSession) as tables:
        known = tables.put("known", linked(pairs.union(few).distinct(), used, maps, threshold))
        return signed.select("k", "a", "b", "node"), components(crowd_links(crowd, used, maps, known, threshold, hubs, tables))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, n: int = 20, rows: int = 5, full: int = 32, hubs: int = 256) -> DataFrame:
    """key, component (the smallest key of the class)."""
    signed, found = classes(docs, key, text, words, threshold, n, rows, full, hubs)
    nodes = signed.groupBy("node").agg(F.min("k").alias("k")).join(found, "node", "left").select("node", "k", F.coalesce("component", "node").alias("component"))
    names = nodes.groupBy("component").agg(F.min("k").alias("least"))
    return signed.select("k", "node").join(nodes.join(names, "component").select("node", "least"), "node").select(F.col("k").alias(key), F.col("least").alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, n: int = 20, rows: int = 5, full: int = 32, hubs: int = 256) -> DataFrame:
    """One row of each class: that of the smallest key.

    Rows that are alike, then those of a node, then the nodes of a class are aggregated, so that a large class is
    no group of one task."""
    signed, found = classes(docs, key, text, words, threshold, n, rows, full, hubs)
    alike_ = signed.groupBy("node", "a", "b").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    first = F.struct(F.col("k").isNull().alias("none"), "k", "a", "b", "n")
    nodes = alike_.groupBy("node").agg(F.min(first).alias("first")).join(found, "node", "left")
    stay = checkpointed(nodes.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select("first.a", "first.b", "first.n"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), *row_names(key, text))
    twins = stay.where("n > 1").select("a", "b")
    if twins.isEmpty():
        return named.join(stay.select("a", "b"), ["a", "b"], "left_semi").select("record.*")
    # rows that stay and are there more than once
    kept = named.join(stay.where("n = 1").select("a", "b"), ["a", "b"], "left_semi").unionByName(named.join(twins, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]))
    return kept.select("record.*")
