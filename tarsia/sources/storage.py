"""Frames that are written once a session to the folder that driver and executors share, and read from there.

The canonical tables and the findings over them are asked for again and again. What is derived is kept under the state of
the given tables (``state``: path, length and time of change of their files), so after a change of these it is derived anew.
Frames are written when a query is built.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock, RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AT_A_TIME = 8  # jobs
Key = tuple[str, str, str]
_KEPT: dict[Key, tuple[str, DataFrame]] = {}
_LOCKS: dict[Key, RLock] = {}
_OWN: dict[str, str | None] = {}  # folders of our own, by application
_GUARD = Lock()


def shared_dir(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; where it is unset, a folder of our own if driver and executors are one process, else None."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and spark.sparkContext.master.startswith("local"):
        with _GUARD:
            there = _OWN.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="tarsia-tables-")
            _OWN[spark.sparkContext.applicationId] = there
    return there


def state(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> tuple[str, int]:
    """A hash over the files of some tables (path, length, time of change), and their bytes. Only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{{{','.join(tables)}}}.parquet")
    row = files.select("path", "length", "modificationTime").agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.coalesce(F.sum("length"), F.lit(0))).first()
    return f"{row[0]}-{row[1]}", row[2]


def once(spark: SparkSession, folder: str, version: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame of that name over a data folder in that state, made at its first use; older ones are dropped."""
    key = (spark.sparkContext.applicationId, folder, name)
    with _GUARD:
        lock = _LOCKS.setdefault(key, RLock())
    with lock:
        if key not in _KEPT or _KEPT[key][0] != version:
            _KEPT[key] = (version, make())
        return _KEPT[key][1]


def kept(spark: SparkSession, folder: str, version: str, name: str, make: Callable[[], DataFrame], spread: bool) -> DataFrame:
    """Likewise, written. Without a shared folder it stays a view. spread: the given tables have too few splits for the
    tasks there are, so rows are dealt out to all of them."""

    def write() -> DataFrame:
        frame, there = make(), shared_dir(spark)
        if not there:
            return frame
        path = f"{there.rstrip('/')}/tarsia-{name}-{uuid.uuid4().hex}"
        (frame.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if spread else frame).write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return once(spark, folder, version, name, write)


def kept_parts(spark: SparkSession, folder: str, version: str, name: str, makes: list[Callable[[], DataFrame]]) -> DataFrame:
    """The union of small frames of one schema, kept likewise. Each is a job of its own, several run at a time: their
    stages are short and leave most of a cluster idle one after the other."""

    def write_all() -> DataFrame:
        there = shared_dir(spark)
        if not there:
            return reduce(DataFrame.unionByName, [make() for make in makes])
        path = f"{there.rstrip('/')}/tarsia-{name}-{uuid.uuid4().hex}"

        def write(k: int) -> StructType:
            frame = makes[k]()
            frame.write.parquet(f"{path}/part={k}")
            return frame.schema

        with ThreadPoolExecutor(AT_A_TIME) as pool:
            schemas = list(pool.map(write, range(len(makes))))
        return spark.read.schema(schemas[0]).parquet(*[f"{path}/part={k}" for k in range(len(makes))])

    return once(spark, folder, version, name, write_all)


def forget(folder: str | None = None) -> None:
    """Drop what was kept of a data folder, or of all: its next use derives it anew."""
    for key in [k for k in _KEPT if folder in (None, k[1])]:
        _KEPT.pop(key, None)
