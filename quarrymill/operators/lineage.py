"""Cutting lineage where a small result is used by many later plans."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset, a local session gets a temporary folder; a cluster, whose
    nodes share no such folder, gets an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Whether Spark deletes the shuffle files of a query as soon as it has ended; read where a query is made.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries made here lose their shuffle files as soon as they have ended: nothing reads
    them again, and the driver may not collect its garbage, on which they would wait,
    before the disk is full."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a written copy in the checkpoint folder, without its shuffle files."""
    _checkpoint_folder(df.sparkSession)
    with cleaned(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, so that df keeps its files


#: Bytes of the rows that a task writing Parquet holds in memory.
_HELD_BYTES = 16 << 20


def stored(df: DataFrame) -> DataFrame:
    """df from a Parquet copy beside the checkpoints, for large rows: it takes about half of the
    disk of a checkpoint, and later plans read only the columns they need.  It stays until the session ends."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    with cleaned(spark):
        df.select("*").write.option("compression", "zstd").option("parquet.block.size", _HELD_BYTES).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's address beside the checkpoints, for files that tasks read again."""
    folder = f"{_checkpoint_folder(spark)}/{uuid4().hex}"
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder made by scratch_folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
