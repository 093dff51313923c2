"""Lineage cuts that survive lost executors: tables written to the shared folder that the cluster names.

The folder is ``spark.checkpoint.dir``. Only a local session, as in tests, may lack it and gets a local one; a cluster
without it is refused, as its nodes share no other folder. Tables are written as Parquet: smaller than a checkpoint's
rows, and read back without the plan's history.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return f"{named or os.path.join(tempfile.gettempdir(), 'cellweave-checkpoints')}/cellweave-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """The frame, computed and written once, then read from the shared folder."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._saved_at = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has saved; frames that read it can't be used any longer."""
    _delete(spark, folder(spark))
    _written.clear()


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables saved within, but for those passed to the function that it gives."""
    start, kept = len(_written), set()
    yield lambda df: kept.add(df._saved_at) or df
    for path in _written[start:]:
        if path not in kept:
            _delete(spark, path)
    _written[start:] = [p for p in _written[start:] if p in kept]


def discard(df: DataFrame) -> None:
    """Deletes the table that ``saved`` made this frame of."""
    _delete(df.sparkSession, df._saved_at)
    _written.remove(df._saved_at)
