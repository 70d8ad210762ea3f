"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash; pass two
permutes each bucket (Spark's seeded shuffle() is a Fisher-Yates permutation) and lays the buckets end to
end, so that a record's global position gives its shard and its slot. Counts of shards differ by one at
most (law ``rows``). write() writes the shards, each in the order of its slots. Only built-in functions run.

Buckets are dealt to tasks by their number, ``task_buckets`` to each, and shuffle() draws from one stream per
task, of the seed and the task's number: positions follow from the records and the parameters alone, however
many partitions Spark uses elsewhere.

Defined cases: a null text has no bytes and size 1; a null key is scattered by its text alone; repeated
rows are separate records, and equal ones of more bytes than a bucket are dealt to as many as they fill; an
empty table gives no rows; other columns stay inside ``record``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prefix_sums


def external_shuffle(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 42, bucket_bytes: int = 4 << 20, task_buckets: int = 16) -> DataFrame:
    """record (struct of all columns), size, bucket, position, shard, slot.

    bucket_bytes times task_buckets bounds what a task holds (one record at least)."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    lot = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text)))
    alike = docs.groupBy(lot.alias("lot")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    big = (F.col("n") > 1) & (F.col("bytes") > bucket_bytes)
    total, crowds = alike.agg(F.sum("bytes"), F.count_if(big)).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), size.alias("size"), lot.alias("lot"))
    if crowds:  # equal records that fill more than a bucket are dealt by their place in the input as well
        parts = alike.where(big).select("lot", F.ceil(2 * F.col("bytes") / bucket_bytes).alias("parts"))
        part = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), "parts")
        dealt = sized.join(parts, "lot", "left").select("record", "size", F.when(F.col("parts").isNull(), F.col("lot")).otherwise(F.xxhash64("lot", part)).alias("lot"))
        sized = checkpointed(dealt)  # places in the input are drawn once
    sized = sized.withColumn("bucket", F.pmod("lot", F.lit(buckets)))
    offsets = prefix_sums(sized.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", "before").select("bucket", "before")
    task = F.floor(F.col("bucket") / task_buckets).cast("int")
    # the order within a bucket is fixed before it is permuted, so that a task that runs again gives the same
    fixed = sized.withColumn("task", task).repartitionById(-(-buckets // task_buckets), F.col("task")).sortWithinPartitions("bucket", "lot", f"record.{key}")
    rows = F.shuffle(F.collect_list(F.struct("record", "size")), F.lit(seed))
    dealt = fixed.groupBy("task", "bucket").agg(rows.alias("rows")).select("bucket", F.posexplode("rows").alias("pos", "row"))
    position = F.col("before") + F.col("pos")
    return (
        dealt.join(F.broadcast(offsets) if buckets <= 100_000 else offsets, "bucket")
        .select("row.record", "row.size", "bucket", position.alias("position"))
        .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("position") / shards))
    )


def write(shuffled: DataFrame, path: str) -> None:
    """The records as Parquet, a folder per shard; files of a shard and rows of a file are in the order of the slots."""
    rows = shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("record.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")).write.mode("overwrite").partitionBy("__shard").parquet(path)
