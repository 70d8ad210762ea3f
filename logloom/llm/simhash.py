"""SimHash near-duplicates through deletion variants.

Fingerprints that differ in two bits at most agree in one of two 32-bit halves but for one bit. Each half
is indexed under its 32 variants with one bit wiped; equal variants meet by an equality shuffle and are
verified. Distinct fingerprints stand for all their documents, so groups of copies count once. A variant
shared by more than ``full`` fingerprints isn't compared pair by pair: its members meet through the
variants of the whole fingerprint with two bits wiped, where equal keys are links.

Defined cases: a null text is like an empty one (fingerprint zero, linked like any other); a document of
fewer words than a shingle is one shingle; repeated rows share a fingerprint; rows without an id get the
component of the other rows of their fingerprint, or null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    import xxhash

    w = (text or "").encode().translate(LOWER).split()  # on the six ASCII blanks
    if not w:
        return 0
    size = min(words, len(w))
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, "i8"), len(w) - size + 1
    for lo in range(0, total, 1 << 15):
        some = w[lo : min(lo + (1 << 15), total) + size - 1]
        h = np.array([digest(b" ".join(s), seed) for s in zip(*(some[k:] for k in range(size)), strict=False)], "<u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits((2 * counts > total).astype("u1"), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3, seed: int = 42) -> Column:
    """The 64-bit fingerprint as a long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([fingerprint(t, words, seed) for t in b.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")(text)


def linked(reps: DataFrame, full: int = 128) -> DataFrame:
    """Links (a, b) between rows of reps (fp, node; each once) whose fingerprints differ in two bits at most."""
    bit = F.col("bit")
    half = F.when(bit < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wiped = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")))
    variants = reps.select("fp", "node", F.explode(F.expr("sequence(0, 63)")).alias("bit")).select("fp", "node", (bit.cast("long") * (1 << 32) + wiped).alias("key"))
    # a key's members are counted by an aggregate and joined to the count, so that no task sorts a whole crowd
    shared = variants.join(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    # bounded groups: verified pairs only
    groups = shared.where(F.col("n") <= full).groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("g"))
    pairs = F.expr("flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> bit_count(x.fp ^ y.fp) <= 2), y -> struct(x.node AS a, y.node AS b))))")
    near = groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    # larger groups: keys of the whole fingerprint that at most four fingerprints share
    crowd = shared.where(F.col("n") > full).select("fp", "node").distinct()
    wipe = F.expr("transform(filter(sequence(0, 4095), p -> p % 64 > p div 64), p -> struct(p AS at, fp & ~(shiftleft(1L, CAST(p % 64 AS INT)) | shiftleft(1L, CAST(p div 64 AS INT))) AS rest))")
    few = crowd.select("node", F.explode(wipe).alias("k")).groupBy("k").agg(F.min("node").alias("a"), F.collect_list("node").alias("all"))
    return near.union(few.select("a", F.explode("all").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """key, fp (long), component (the smallest key reachable over links of two bits at most)."""
    fps = checkpointed(docs.select(key, fingerprints(F.col(text), words, seed).alias("fp")))
    reps = checkpointed(fps.groupBy("fp").agg(F.min(key).alias("node")).where("node IS NOT NULL"))
    found = components(linked(reps))
    classes = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(classes, "fp", "left").select(key, "fp", "component")
