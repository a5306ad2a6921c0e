"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a fresh one of our own if driver and
    executors are one process, else an error: a folder of this machine is none that they share."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not there:
        there = "file://" + tempfile.mkdtemp(prefix="tarsia-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


def renamed(df: DataFrame, without: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df without the columns that an operator adds, all others under names that clash with none of its own, and the
    new name of each."""
    own = {c: f"in_{k}" for k, c in enumerate(c for c in df.columns if c.lower() not in without)}
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in own.items()]), own


def restored(own: dict[str, str]) -> list[Column]:
    """The columns of such a frame under their first names."""
    return [F.col(n).alias(c) for c, n in own.items()]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and go on from there: no recomputation, no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut, but a Parquet table in that folder, read again: its size is known. A checkpoint keeps the estimate of
    the plan it ends, and over many rounds of joins estimates become products too long to multiply in time."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a materialised frame for broadcast if it has at most max_rows rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: TOKENIZER_DIR, if set, else the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
