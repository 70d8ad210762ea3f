"""Upkeep of derived tables: a change is followed through a graph of tables, and only the buckets it reaches are written.

A table's rows lie in buckets by a key (a session, a repository). A run writes the buckets that hold a key whose
rows may change, into a folder of its own, and then one manifest that says for every bucket which run wrote it.
The manifest is a single file put in place at once: before it readers see the old state, after it the new one,
and what a run that died has left behind is never read.

The driver holds a row for each bucket, never one for each key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.checkpoints import checkpointed

BUCKET_BYTES = 256 << 20
MOST_BUCKETS = 1 << 16
#: (table, bucket) to (run, rows, version)
Manifest = dict[tuple[str, int], tuple[int, int, str]]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def buckets_for(source_bytes: int) -> int:
    """As many as give each about BUCKET_BYTES of the sources."""
    return max(8, min(MOST_BUCKETS, -(-source_bytes // BUCKET_BYTES)))


class Store:
    """Bucketed tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.run, self.buckets = 0, 0
        self.manifest: Manifest = {}
        self.schemas: dict[str, str] = {}
        self.load()

    def load(self) -> None:
        """The state of the last whole run."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/manifest")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return
            raise
        self.run = rows.agg(F.max("written")).first()[0]
        for r in rows.where(F.col("written") == self.run).collect():  # a row per table and bucket
            self.buckets = r["buckets"]
            self.schemas[r["name"]] = r["schema"]
            if r["rows"]:
                self.manifest[r["name"], r["bucket"]] = (r["run"], r["rows"], r["version"])

    def runs(self) -> DataFrame:
        """The manifests of all runs: written (the run), and for each bucket of each table the run that wrote it, its rows and version."""
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def read(self, name: str, only: set[int] | None = None, manifest: Manifest | None = None) -> DataFrame | None:
        """A table, or those of its buckets; None if it was never written."""
        if name not in self.schemas:
            return None
        now = self.manifest if manifest is None else manifest
        where = [f"{self.folder}/{name}/run={run}/bucket={b}" for (n, b), (run, _, _) in now.items() if n == name and (only is None or b in only)]
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        if not where:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*where)

    def write(self, run: int, name: str, rows: DataFrame, key: str) -> dict[int, int]:
        """Rows by bucket, in the run's own folder; the number of rows of each bucket that has some."""
        self.schemas[name] = json.dumps(json.loads(rows.schema.json()))
        path = f"{self.folder}/{name}/run={run}"
        # a bucket of any size is as many files as it needs
        rows.withColumn("bucket", bucket_of(F.col(key), self.buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        try:
            return {r["bucket"]: r["n"] for r in self.spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        except Exception as e:  # noqa: BLE001
            if "UNABLE_TO_INFER_SCHEMA" in str(e):  # no rows, no files
                return {}
            raise

    def commit(self, run: int, manifest: Manifest) -> None:
        """Puts a run's state in place: one file, renamed once it is whole."""
        rows = [(name, b, r, n, v, self.schemas[name], self.buckets) for (name, b), (r, n, v) in manifest.items()]
        rows += [(name, -1, run, 0, "", schema, self.buckets) for name, schema in self.schemas.items()]
        made = self.spark.createDataFrame(rows, "name string, bucket int, run int, rows long, version string, schema string, buckets int")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/written={run}")
        self.run, self.manifest = run, manifest


@dataclass(frozen=True)
class Table:
    """make(run, keys): the rows of those keys (of all, if None). spread: how what is dirty reaches other keys."""

    make: Callable[[Run, DataFrame | None], DataFrame]
    key: str = "sid"
    domain: str = "session"
    needs: tuple[str, ...] = ()
    spread: str = "own"
    version: str = "1"


@dataclass
class Run:
    """One run over a store: what it has written so far is read by the tables that need it."""

    store: Store
    source: Any
    number: int
    manifest: Manifest
    written: dict[str, int] = field(default_factory=dict)
    made: dict[tuple[str, int], DataFrame] = field(default_factory=dict)
    locks: dict[tuple[str, int], Lock] = field(default_factory=dict)
    guard: Lock = field(default_factory=Lock)

    def read(self, name: str) -> DataFrame:
        found = self.store.read(name, manifest=self.manifest)
        if found is None:
            raise KeyError(name)
        return found

    def once(self, what: str, keys: DataFrame | None, make: Callable[[], DataFrame]) -> DataFrame:
        """What several tables work out from the same keys."""
        with self.guard:
            lock = self.locks.setdefault((what, id(keys)), Lock())
        with lock:
            if (what, id(keys)) not in self.made:
                self.made[what, id(keys)] = make()
            return self.made[what, id(keys)]

    def before(self, name: str) -> DataFrame | None:
        return self.store.read(name)


def only(df: DataFrame, keys: DataFrame | None, column: str) -> DataFrame:
    """The rows whose column is one of keys (a table of one column)."""
    if keys is None:
        return df
    name = keys.columns[0]
    return df.join(keys.select(F.col(name).alias(column)), column, "left_semi")


#: From the changed keys to those of a kind of table; both a table of one column.
Spread = Callable[[Run, DataFrame], DataFrame]


def upkeep(store: Store, source: Any, tables: Mapping[str, Table], changed: DataFrame | None, spreads: Mapping[str, Spread], at_once: int = 6) -> Run:
    """A run over all tables. changed: the keys (sid) whose source rows changed; None: everything is made anew.

    A table's dirty keys are those that its spread makes of the changed ones, those of the tables it needs that
    share its domain of keys, and all keys of buckets that another version of it wrote."""
    run = Run(store, source, store.run + 1, dict(store.manifest))
    spread_keys: dict[str, DataFrame] = {}
    dirty: dict[str, DataFrame | None] = {}
    jobs: dict[str, Future[None]] = {}

    guard = Lock()

    def reached(kind: str) -> DataFrame:
        with guard:
            if kind not in spread_keys:
                spread_keys[kind] = checkpointed((changed if kind == "own" else spreads[kind](run, changed)).distinct())
            return spread_keys[kind]

    def one(name: str) -> None:
        table = tables[name]
        for other in table.needs:
            jobs[other].result()
        stored = store.read(name)
        keys: DataFrame | None = None
        if changed is not None and stored is not None:
            sets = {id(k): k for k in (reached(table.spread), *(dirty[o] for o in table.needs if tables[o].domain == table.domain)) if k is not None}
            if table.spread != "own" and len(sets) > 1:
                sets.pop(id(spread_keys.get("own")), None)  # a spread holds what it began with
            old = {b for (n, b), (_, _, v) in store.manifest.items() if n == name and v != table.version}
            parts = list(sets.values())
            if old:
                parts.append(store.read(name, old).select(F.col(table.key).alias(parts[0].columns[0])))
            keys = parts[0] if len(parts) == 1 else checkpointed(reduce(DataFrame.union, parts).distinct())
        dirty[name] = keys
        rows = table.make(run, keys)
        touched = None
        if keys is not None:
            touched = {r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), store.buckets)).distinct().collect()}  # at most one for each bucket
            if not touched:
                return
            kept = store.read(name, touched).join(keys.select(F.col(keys.columns[0]).alias(table.key)), table.key, "left_anti")
            rows = rows.unionByName(kept.select(rows.columns))
        found = store.write(run.number, name, rows, table.key)
        for k in [k for k in run.manifest if k[0] == name and (touched is None or k[1] in touched)]:
            del run.manifest[k]
        run.manifest.update({(name, b): (run.number, n, table.version) for b, n in found.items()})
        run.written[name] = store.buckets if touched is None else len(touched)

    order = sorted(tables, key=lambda n: depth_of(tables, n))
    with ThreadPoolExecutor(at_once) as pool:
        for name in order:  # what a table needs was put in line before it
            jobs[name] = pool.submit(one, name)
        for job in jobs.values():
            job.result()
    store.commit(run.number, run.manifest)
    return run


def depth_of(tables: Mapping[str, Table], name: str) -> int:
    return 1 + max((depth_of(tables, n) for n in tables[name].needs), default=0)


def with_needs(tables: Mapping[str, Table], names: Iterable[str]) -> dict[str, Table]:
    """The named tables and all that they need."""
    found = set(names)
    while more := {o for n in found for o in tables[n].needs} - found:
        found |= more
    return {n: t for n, t in tables.items() if n in found}


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, modified_at) of the files under paths; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified_at"))


def file_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, state): files that are new, changed or gone."""
    a, b = now.alias("a"), before.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.modified_at").eqNullSafe(F.col("b.modified_at"))
    state = F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "gone").when(~same, "changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state")).where("state IS NOT NULL")


def changed_keys(now: DataFrame, before: DataFrame) -> DataFrame:
    """(sid) whose rows differ. Both: sid, path, n, digest of the files that changed; rows that only moved to another file don't count."""
    whole = lambda df: df.groupBy("sid").agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"))
    a, b = whole(now).alias("a"), whole(before).alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    return a.join(b, F.col("a.sid") == F.col("b.sid"), "full").where(~same).select(F.coalesce("a.sid", "b.sid").alias("sid"))
