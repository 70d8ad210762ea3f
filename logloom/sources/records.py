"""Record lines of session logs: reading, typing, token counters, and the shape of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.vectors import FIELDS

MAX_LINE = 1 << 20
# Names under which logs carry the counters.
ALIASES = {
    "input_tokens": ("input_tokens", "prompt_tokens"),
    "cached_input_tokens": ("cached_input_tokens",),
    "output_tokens": ("output_tokens", "completion_tokens"),
    "reasoning_output_tokens": ("reasoning_output_tokens",),
    "cache_write_input_tokens": ("cache_write_input_tokens",),
    "total_tokens": ("total_tokens",),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, last, terminated, line): lines of text files with their place from 0, also where a file is read in several splits.

    Lines are counted by split; a split's lines follow those of the splits before it in its file, and a line's place
    in its split is told by its distance from the split's first. So only counts are ordered, a row for each split.
    terminated: whether the file's last line ends in a line feed, told from the file's size."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes"), F.first("size").alias("size"))
    order, whole = W.partitionBy("file").orderBy("block"), W.partitionBy("file")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum("n").over(whole)
    splits = splits.select("file", "block", "first", before.alias("before"), all_.alias("all"), (F.sum("bytes").over(whole) + all_ <= F.col("size")).alias("terminated"))
    rows = raw.join(splits, ["file", "block"]).withColumn("ordinal", F.col("before") + F.col("at") - F.col("first"))
    return rows.select("file", "ordinal", (F.col("ordinal") == F.col("all") - 1).alias("last"), "terminated", "line")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(log, ordinal, last, terminated, line): lines of files that hold many logs, one after the other, each line after its log's name and a tab.

    Places are told within a log; only a file's last log can end without a line feed."""
    rows = lines(spark, path).withColumn("log", F.substring_index("line", "\t", 1))
    logs = rows.groupBy("file", "log").agg(F.min("ordinal").alias("__first"), F.max("ordinal").alias("__end"), F.bool_or(F.col("last") & ~F.col("terminated")).alias("__open"))
    rows = rows.select("file", "log", F.col("ordinal").alias("__at"), F.expr("substr(line, length(log) + 2)").alias("line")).join(logs, ["file", "log"])
    return rows.select("log", (F.col("__at") - F.col("__first")).alias("ordinal"), (F.col("__at") == F.col("__end")).alias("last"), (~F.col("__open")).alias("terminated"), "line")


def got(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def number(v: Column, path: str) -> Column:
    """A number that isn't negative; text and booleans do not count."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    x = got(v, path, "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (x >= 0), F.floor(x)).cast("long")


def counters(v: Column, base: str) -> Column:
    """The vector of counters in the object at base, null where there is none; the total is input and output where it is missing."""
    found = {f: F.coalesce(*[number(v, f"{base}.{n}") for n in names]) for f, names in ALIASES.items()}
    found["total_tokens"] = F.coalesce(found["total_tokens"], found["input_tokens"] + found["output_tokens"])
    there = F.schema_of_variant(F.try_variant_get(v, base, "variant")).startswith("OBJECT")
    return F.when(there, F.struct(*[found[f].cast("long").alias(f) for f in FIELDS]))


def short(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(F.length(t) <= 4096, t)


def parsed(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with status (oversized, partial, malformed or ok; partial: the last line of a file, cut short), record and payload type, role, text, cumulative and delta vectors."""
    big = F.octet_length(line) > MAX_LINE
    v = F.when(~big, F.try_parse_json(F.col(line)))
    rows = rows.withColumn("__v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    v = F.col("__v")
    open_end = F.col("last") & ~F.col("terminated") if {"last", "terminated"} <= set(rows.columns) else F.lit(False)
    text = F.array_join(F.transform(F.try_variant_get(v, "$.payload.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), "\n")
    return rows.select(
        *[F.col(c) for c in rows.columns if c not in ("__v", line)],
        F.when(big, "oversized").when(v.isNull() & open_end, "partial").when(v.isNull(), "malformed").otherwise("ok").alias("status"),
        short(F.coalesce(*[got(v, f"$.{k}") for k in ("type", "event", "kind")])).alias("record_type"),
        short(got(v, "$.payload.type")).alias("payload_type"),
        got(v, "$.payload.role").alias("role"),
        F.coalesce(got(v, "$.payload.message"), text).alias("text"),
        counters(v, "$.payload.info.total_token_usage").alias("cumulative"),
        F.coalesce(counters(v, "$.payload.info.last_token_usage"), counters(v, "$.usage"), counters(v, "$.payload.usage"), counters(v, "$.payload.token_usage")).alias("delta"),
    )


def inner(x: Column) -> Column:
    """The fields of an object, the items of a list: array of path and value."""
    kind = F.regexp_extract(F.schema_of_variant(x["v"]), "^[A-Z]+", 0)
    fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string, variant>")), lambda e: F.struct(F.concat_ws(".", x["path"], e["key"]).alias("path"), e["value"].alias("v")))
    items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda e: F.struct(F.concat(x["path"], F.lit("[]")).alias("path"), e.alias("v")))
    return F.coalesce(F.when(kind == "OBJECT", fields).when(kind == "ARRAY", items), F.array().cast("array<struct<path: string, v: variant>>"))


def field_profile(rows: DataFrame, line: str = "line", depth: int = 6) -> DataFrame:
    """(path, type, n, min, max and mean text length) of the fields of JSON lines, depth levels down; never values.

    All levels of a line are unfolded within its row, so that the source is read and parsed once."""
    now = rows.select(F.struct(F.lit("$").alias("path"), F.try_parse_json(F.col(line)).alias("v")).alias("x")).where("x.v IS NOT NULL").select(inner(F.col("x")).alias("l1"))
    for k in range(2, depth + 1):
        now = now.withColumn(f"l{k}", F.flatten(F.transform(f"l{k - 1}", inner)))
    found = now.select(F.explode(F.concat(*[F.col(f"l{k}") for k in range(1, depth + 1)])).alias("x")).select("x.path", F.regexp_extract(F.schema_of_variant("x.v"), "^[A-Z]+", 0).alias("type"), F.length(F.try_variant_get("x.v", "$", "string")).alias("len"))
    text = F.when(F.col("type") == "STRING", F.col("len"))
    return found.groupBy("path", "type").agg(F.count("*").alias("n"), F.min(text).alias("shortest"), F.max(text).alias("longest"), F.avg(text).alias("mean_length"))


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the listing (path, size, modified_at) that the manifest does not have just so."""
    keys = ["path", "size", "modified_at"]
    a, b = listing.alias("a"), manifest.select(*keys).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left_anti")
