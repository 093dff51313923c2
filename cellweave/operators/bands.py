"""Altitude bands expanded to height layers and cells. Every expansion is a projection: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes


def height_layers(bands: DataFrame, low: str = "height_min", high: str = "height_max", level: str = "level") -> DataFrame:
    """A row for each layer from the band's lower end to its upper, both included; reversed ends are swapped."""
    first, last = codes.height_index(F.least(low, high), level), codes.height_index(F.greatest(low, high), level)
    return bands.withColumn("layer", F.explode(F.sequence(first, last)))


def height_band(bands: DataFrame, strict: bool = True) -> DataFrame:
    """A code for each layer of a band (x, y, height_min, height_max, level, toff, lt). A layer that the code can't hold
    raises, or gives null if not ``strict``."""
    return height_layers(bands).withColumn("grid_code", codes.encode_cell("x", "y", "layer", "level", "toff", "lt", strict))


def height_capacity_report(bands: DataFrame, bits: int = codes.WIDTHS["z"]) -> DataFrame:
    """Bands with the bits that their layers need, whether these fit, and the finest level at which they would."""
    top = F.greatest("height_min", "height_max")
    fits = lambda n: codes.height_layer_fits(n, top, bits)
    best = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(codes.MAX_LEVEL)), fits))
    return bands.withColumn("bits_needed", codes.height_layer_bits("level", top)).withColumn("fits", F.col("bits_needed") <= bits).withColumn("best_level", best)
