"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder and a
    cluster an error, as its executors don't share one.

    Old checkpoints go with their tables where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table in the folder that all executors share, for tables that each round of a loop makes from its last.

    Plans of such loops over checkpoints alone were seen not to end after a few rounds; a table that is read anew
    brings nothing of its plan with it. It stays until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffles go then, and checkpoints that are to be cleaned, to which nothing refers any more.

    For loops of many small steps; without it they stay until the driver's memory fills."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of a job's steps in a folder of the shared one: a table put under a name that has one takes its place, and the old one goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """What df holds, as a table; df may read the table that it replaces, but nothing may read that one after."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            self._remove(path)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch whose folder goes at the end, also if the job fails."""
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables._remove(tables.folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (see checkpointed).

    Also turns off a rule of Spark 4.1 for the session: by it unions of tables dealt by one key were taken for dealt
    by it, and after joins by shuffle their groups came in parts, one for each table (session outcomes did)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return str(sc.getCheckpointDir())
