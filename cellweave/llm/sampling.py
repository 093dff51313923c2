"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(rows: DataFrame, order: Column, label: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each label: those of the least ``order``, a hash of the row's id.

    Rows are cut by the hash first, to about twice the limit, so only few are ranked; a rare label keeps all its rows.
    The labels must be few (a classifier's classes), as their counts are sent to every task.
    """
    marked = rows.withColumn("_order", order)
    sizes = marked.groupBy(label).agg(F.count("*").alias("_n"))
    low = F.pmod("_order", F.lit(1 << 20)) < F.lit(float(1 << 20)) * (2.0 * limit + 100) / F.col("_n")
    # One row a label; else the join may send every labelled row to its label's task before the cut.
    few = marked.join(F.broadcast(sizes), label).where(low)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.pmod("_order", F.lit(1 << 20)), "_order"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_order", "_n", "_rank")
