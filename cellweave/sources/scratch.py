"""Places for files that a query or an operator writes and reads again: the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Only a local session, as in tests, may lack it and gets a local folder; a
    cluster without it is refused, as its nodes share no other folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return f"{named or os.path.join(tempfile.gettempdir(), 'cellweave-scratch')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame, computed and written once, then read from the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
