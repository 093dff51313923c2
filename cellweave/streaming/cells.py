"""Cell operators on streams.

Encoding, heights and band expansion are projections, so the batch functions take a streaming frame as it is. A set
test against a fixed zone table is a stream-static join, which keeps no state; a count of distinct common cells in
time windows is a watermarked aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import bands, sets


def band_cells(stream: DataFrame, strict: bool = False) -> DataFrame:
    """Altitude bands as they arrive, a row for each of their cells."""
    return bands.height_band(stream, strict)


def zone_hits(stream: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows of a cell stream whose code lies in a zone, with the zone's id."""
    fixed = sets.prepared(zones).select(F.col("set_id").alias("zone_id"), "grid_code")
    return stream.join(fixed, "grid_code")


def windowed_overlap(stream: DataFrame, zones: DataFrame, moment: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, set_id, zone_id, overlap): distinct common cells in each window; rows later than ``late`` are dropped by the watermark.

    The window is in the key of what counts once, so a cell counts anew in each window. State: a row for each window, pair
    and cell until the watermark has passed the window.
    """
    hits = zone_hits(stream.withWatermark(moment, late), zones).withColumn("window", F.window(moment, window))
    hits = hits.dropDuplicates(["window", "set_id", "zone_id", "grid_code"])
    return hits.groupBy("window", "set_id", "zone_id").agg(F.count("*").alias("overlap"))
