"""Derived tables: written once for a state of the sources, read by every query.

A table is named after the function that makes it and lies in the shared folder under a digest of the source
files' paths, sizes and times: sources that change get new tables, sources that don't are read no more."""

from __future__ import annotations

import functools
import hashlib
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.checkpoints import shared_folder

SOURCES = ("conversations", "events", "documents")
Make = Callable[[SparkSession, str], DataFrame]
TABLES: dict[str, Make] = {}
_written: dict[str, threading.Lock] = {}
_done: set[str] = set()
_guard = threading.Lock()
_now = threading.local()


def state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the source files; only their listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{{{','.join(SOURCES)}}}.parquet")
    names = F.xxhash64("path", "length", "modificationTime")
    return hashlib.sha256(repr(tuple(files.agg(F.count("*"), F.bit_xor(names)).first())).encode()).hexdigest()[:24]


@contextmanager
def one_state(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Inside, the sources' state is looked up once."""
    before = getattr(_now, "key", None)
    _now.key = (sf_dir, state(spark, sf_dir))
    try:
        yield
    finally:
        _now.key = before


def path_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = getattr(_now, "key", None)
    digest = key[1] if key and key[0] == sf_dir else state(spark, sf_dir)
    return f"{shared_folder(spark)}/tables-{digest}/{name}"


def is_written(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return path_of(spark, sf_dir, name) in _done


def written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The path under that name for the sources' state; the first call writes it."""
    path = path_of(spark, sf_dir, name)
    with _guard:
        lock = _written.setdefault(path, threading.Lock())
    with lock:
        if path not in _done:
            write(path)
            _done.add(path)
    return path


def stored(make: Make) -> Make:
    """The function's table, read from where it was written; the first call writes it."""

    @functools.wraps(make)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(written(spark, sf_dir, make.__name__, lambda path: make(spark, sf_dir).write.mode("overwrite").parquet(path)))

    TABLES[make.__name__] = read
    return read


def build(spark: SparkSession, sf_dir: str, names: list[str] | None = None, at_once: int = 6) -> None:
    """All tables (or those named), several jobs at once; a table that another needs is written first, once."""
    digest = state(spark, sf_dir)

    def one(name: str) -> None:
        _now.key = (sf_dir, digest)
        TABLES[name](spark, sf_dir)

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, names or list(TABLES)))
