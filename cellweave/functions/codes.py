"""Column functions over 64-bit grid codes, heights, bins and minute blocks.

A code is a BIGINT that holds the bits ``X17|Y17|Z7|L5|Toff14|Lt4``; DECIMAL(20,0) is its unsigned form. Functions that
check ranges take ``strict``: True raises on a bad value, False gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit widths of the layout's fields from the highest to the lowest, and the earth model.
WIDTHS = {"x": 17, "y": 17, "z": 7, "level": 5, "toff": 14, "lt": 4}
LAYOUT = {"layout_id": "geosot3d-v1-x17-y17-z7-l5-toff14-lt4", "version": "1", "bits": "64", "x_bits": "17", "y_bits": "17", "z_bits": "7", "level_bits": "5", "toff_bits": "14", "lt_bits": "4"}
EARTH_RADIUS = 6378137.0
DEGREE = math.pi / 180
MAX_LEVEL = 32
MAX_LAYER = 127
TOFF_ORIGIN = "2026-09-06 22:00:00+08:00"

SHIFTS = {}
_left = 64
for _name, _bits in WIDTHS.items():
    _left -= _bits
    SHIFTS[_name] = _left


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _long(x) -> Column:
    return _col(x).cast("bigint")


def checked(value: Column, ok: Column, message: str, strict: bool) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)) if strict else F.lit(None))


def encode_cell(x, y, z, level, toff, lt, strict: bool = True) -> Column:
    """Six parts as one code; each must fit its field."""
    parts = dict(zip(WIDTHS, map(_long, (x, y, z, level, toff, lt))))
    code, fits = None, F.lit(True)
    for name, part in parts.items():
        placed = F.shiftleft(part, SHIFTS[name])
        code = placed if code is None else code.bitwiseOR(placed)
        fits = fits & part.between(0, (1 << WIDTHS[name]) - 1)
    return checked(code, fits, "a part of the grid code is out of range", strict)


def part_of(code, name: str) -> Column:
    return F.shiftrightunsigned(_col(code), SHIFTS[name]).bitwiseAND(F.lit((1 << WIDTHS[name]) - 1)).cast("int")


def decode_cell(code) -> Column:
    return F.struct(*[part_of(code, name).alias(name) for name in WIDTHS])


def to_unsigned(code) -> Column:
    c = _col(code)
    high, low = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")


def from_unsigned(value) -> Column:
    """A BIGINT code for a number in [0, 2^64); null outside."""
    v = _col(value).cast("decimal(38,0)")
    size = F.lit(1 << 32).cast("decimal(38,0)")
    code = F.shiftleft(F.call_function("div", v, size), 32).bitwiseOR((v % size).cast("bigint"))
    return F.when(v.between(F.lit(0), F.expr("18446744073709551615BD")), code)


def unsigned_order(code) -> list[Column]:
    """Sort keys that put codes in the order of their unsigned values."""
    c = _col(code)
    return [F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))]


def cell_to_hex(code) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(_col(code)), 16, "0"))


def number_from_text(text) -> Column:
    """The number that decimal or 0x text stands for, as DECIMAL(38,0); null if it is none."""
    t = F.trim(_col(text))
    hexed = F.lower(t).rlike("^0x[0-9a-f]{1,16}$")
    unsigned = F.conv(F.substring(t, 3, 40), 16, 10)
    return F.when(hexed, unsigned.try_cast("decimal(38,0)")).when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("decimal(38,0)"))


def cell_from_text(text) -> Column:
    # Most codes are decimal and below 2^63; the others take a DECIMAL.
    t = F.trim(_col(text))
    small = t.try_cast("bigint")
    return F.when(t.rlike("^[+-]?[0-9]+$") & (small >= 0), small).otherwise(from_unsigned(number_from_text(text)))


def cell_is_valid(text) -> Column:
    n = number_from_text(text)
    return F.coalesce(n.between(F.lit(0), F.expr("18446744073709551615BD")), F.lit(False))


def quantize(value, low: float, high: float, bits: int = 8, strict: bool = True) -> Column:
    """The bin of a value, halves rounded up; values outside [low, high] raise or give null."""
    v = _col(value).cast("double")
    bin_ = F.floor((v - low) / (high - low) * float((1 << bits) - 1) + 0.5).cast("bigint")
    return checked(bin_, v.between(low, high), "a value to quantise is out of range", strict)


# --- levels and heights -------------------------------------------------------------------------------------------


def _level(level) -> Column:
    """A level as a number; one outside [0, 32] raises, null stays null."""
    k = _col(level).cast("double")
    return F.when(k.between(0, MAX_LEVEL), k).when(k.isNotNull(), F.raise_error(F.lit("a level is out of range")))


def cell_deg(level) -> Column:
    """Span of a cell in degrees: whole degrees to level 9, then minutes, seconds, and 1/2048 of a second."""
    k = _level(level)
    return F.when(k <= 9, F.pow(F.lit(2.0), 9 - k)).when(k <= 15, F.pow(F.lit(2.0), 15 - k) / 60.0).when(k <= 21, F.pow(F.lit(2.0), 21 - k) / 3600.0).otherwise(F.pow(F.lit(2.0), 32 - k) / 2048.0 / 3600.0)


def cells_per_deg(level) -> Column:
    k = _level(level)
    return F.when(k <= 15, F.pow(F.lit(2.0), k - 9)).otherwise(3600.0 * F.pow(F.lit(2.0), k - 21))


def equator_scale(level) -> Column:
    return F.lit(EARTH_RADIUS * DEGREE) * cell_deg(level)


def height_layer_lower(layer, level) -> Column:
    return F.lit(EARTH_RADIUS) * (F.pow(F.lit(1.0 + DEGREE), _col(layer).cast("double") * cell_deg(level)) - 1.0)


def height_cell(level) -> Column:
    return height_layer_lower(F.lit(1), level)


def height_layer_bounds(layer, level) -> Column:
    n = _col(layer)
    return F.struct(height_layer_lower(n, level).alias("lower"), height_layer_lower(n + 1, level).alias("upper"))


def height_index(height, level, strict: bool = True) -> Column:
    """The layer that holds a height; at or below minus the earth's radius there is none."""
    h = _col(height).cast("double")
    ok = h > -EARTH_RADIUS
    layer = F.floor(F.log1p(F.when(ok, h) / EARTH_RADIUS) / F.lit(math.log1p(DEGREE)) / cell_deg(level)).cast("bigint")
    return checked(layer, ok, "a height lies below the earth's centre", strict)


def height_layer_count(low, high, level) -> Column:
    a, b = _col(low), _col(high)
    return height_index(F.greatest(a, b), level) - height_index(F.least(a, b), level) + 1


def height_layer_bits(level, highest) -> Column:
    """Bits for the layers of [0, highest], at least one."""
    top = F.greatest(F.lit(0), height_index(F.greatest(F.lit(0.0), _col(highest).cast("double")), level))
    return F.length(F.bin(top))


def height_layer_fits(level, highest, bits: int = WIDTHS["z"]) -> Column:
    return height_layer_bits(level, highest) <= bits


def height_layer_valid(layer, bits: int = WIDTHS["z"]) -> Column:
    return _col(layer).between(0, (1 << bits) - 1)


def max_supported_height(level, bits: int = WIDTHS["z"]) -> Column:
    return height_layer_lower(F.lit((1 << bits) - 1), level)


def encode_cell_at_height(x, y, level, height, toff=0, lt=0, strict: bool = True) -> Column:
    return encode_cell(x, y, height_index(height, level, strict), level, toff, lt, strict)


def cell_height_interval(code) -> Column:
    z, level = part_of(code, "z"), part_of(code, "level")
    return F.struct(z.alias("layer"), level.alias("level"), height_layer_lower(z, level).alias("lower"), height_layer_lower(z + 1, level).alias("upper"))


# --- time ---------------------------------------------------------------------------------------------------------


def toff_lenient(moment, origin: str = TOFF_ORIGIN) -> Column:
    """Whole minutes since the origin, rounded down, also before it. A moment without a zone is taken in the session's."""
    micros = F.unix_micros(_col(moment).cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))
    minute = F.lit(60_000_000)
    return F.call_function("div", micros - F.pmod(micros, minute), minute)


def toff_strict(moment, origin: str = TOFF_ORIGIN, strict: bool = True) -> Column:
    """The same; moments before the origin raise or give null."""
    n = toff_lenient(moment, origin)
    return checked(n, n >= 0, "a moment lies before the origin", strict)


def node_end(toff, lt) -> Column:
    return _long(toff) + F.call_function("shiftleft", F.lit(1).cast("bigint"), _col(lt).cast("int"))


def node_span(toff, lt) -> Column:
    return F.struct(_long(toff).alias("start"), node_end(toff, lt).alias("end"))


def node_is_aligned(toff, lt) -> Column:
    t = _long(toff)
    return (t >= 0) & (_col(lt) >= 0) & (F.pmod(t, F.call_function("shiftleft", F.lit(1).cast("bigint"), _col(lt).cast("int"))) == 0)


# --- vectors ------------------------------------------------------------------------------------------------------


def floor_div(value: Column, by) -> Column:
    """Division of whole numbers rounded towards minus infinity."""
    d = _long(by)
    return F.call_function("div", value - F.pmod(value, d), d)


def l2_squared(a, b) -> Column:
    """Sum of squared differences; vectors of different lengths raise."""
    x, y = _col(a), _col(b)
    total = F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0).cast("bigint"), lambda s, d: s + d)
    return checked(total, F.size(x) == F.size(y), "vectors differ in length", True)


def distance_le(a, b, threshold, scale_a=None, scale_b=None) -> Column:
    """Whether two vectors lie within a distance; a negative threshold acts as its absolute value."""
    t = _long(threshold)
    near = l2_squared(a, b) <= t * t
    return near if scale_a is None else checked(near, _col(scale_a) == _col(scale_b), "vectors differ in scale", True)


def weighted_sum(values, weights, scale=1) -> Column:
    """Sum of value times weight, divided by the weights' scale and rounded down."""
    v, w = _col(values), _col(weights)
    total = F.aggregate(F.zip_with(v, w, lambda p, q: p * q), F.lit(0).cast("bigint"), lambda s, d: s + d)
    return checked(floor_div(total, scale), F.size(v) == F.size(w), "values and weights differ in length", True)


def vector_is_valid(values, scale=1) -> Column:
    """No element missing, and a positive scale."""
    return ~F.exists(_col(values), lambda v: v.isNull()) & (_long(scale) > 0)


def register_sql(spark) -> None:
    """The scalar functions as temporary SQL functions of the session, by the names that they have here.

    They check as the strict forms do: what is out of range raises.
    """
    part = lambda n: f"CAST(shiftrightunsigned(c, {SHIFTS[n]}) & {(1 << WIDTHS[n]) - 1} AS INT)"
    fits = " AND ".join(f"{n} BETWEEN 0 AND {(1 << bits) - 1}" for n, bits in WIDTHS.items())
    code = " | ".join(f"shiftleft({n}, {SHIFTS[n]})" for n in WIDTHS)
    refused = lambda what, kind: f"CAST(raise_error('{what}') AS {kind})"
    number = "CASE WHEN lower(trim(t)) RLIKE '^0x[0-9a-f]{1,16}$' THEN try_cast(conv(substring(trim(t), 3, 40), 16, 10) AS DECIMAL(38,0)) WHEN trim(t) RLIKE '^[+-]?[0-9]+$' THEN try_cast(trim(t) AS DECIMAL(38,0)) END"
    level, most = f"CASE WHEN level BETWEEN 0 AND {MAX_LEVEL} THEN CAST(level AS DOUBLE) WHEN level IS NOT NULL THEN {refused('a level is out of range', 'DOUBLE')} END", (1 << WIDTHS["z"]) - 1
    for sql in (
        f"cell_encode({', '.join(f'{n} BIGINT' for n in WIDTHS)}) RETURNS BIGINT RETURN CASE WHEN {fits} THEN {code} ELSE {refused('a part of the grid code is out of range', 'BIGINT')} END",
        f"cell_decode(c BIGINT) RETURNS STRUCT<{', '.join(f'{n}: INT' for n in WIDTHS)}> RETURN named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {part(n)}' for n in WIDTHS)})",
        "cell_hex(c BIGINT) RETURNS STRING RETURN concat('0x', lpad(hex(c), 16, '0'))",
        "cell_unsigned(c BIGINT) RETURNS DECIMAL(20,0) RETURN CAST(CASE WHEN c < 0 THEN CAST(c AS DECIMAL(21,0)) + 18446744073709551616BD ELSE c END AS DECIMAL(20,0))",
        f"number_from_text(t STRING) RETURNS DECIMAL(38,0) RETURN {number}",
        "cell_is_valid(t STRING) RETURNS BOOLEAN RETURN coalesce(number_from_text(t) BETWEEN 0 AND 18446744073709551615BD, false)",
        "cell_from_text(t STRING) RETURNS BIGINT RETURN CASE WHEN cell_is_valid(t) THEN CAST(CASE WHEN number_from_text(t) > 9223372036854775807BD THEN number_from_text(t) - 18446744073709551616BD ELSE number_from_text(t) END AS BIGINT) END",
        f"quantize(v DOUBLE, low DOUBLE, high DOUBLE, bits INT) RETURNS BIGINT RETURN CASE WHEN v BETWEEN low AND high THEN CAST(floor((v - low) / (high - low) * CAST(shiftleft(1L, bits) - 1 AS DOUBLE) + 0.5D) AS BIGINT) ELSE {refused('a value to quantise is out of range', 'BIGINT')} END",
        f"level_of(level INT) RETURNS DOUBLE RETURN {level}",
        "cell_deg(level INT) RETURNS DOUBLE RETURN CASE WHEN level_of(level) <= 9 THEN pow(2D, 9 - level) WHEN level <= 15 THEN pow(2D, 15 - level) / 60D WHEN level <= 21 THEN pow(2D, 21 - level) / 3600D ELSE pow(2D, 32 - level) / 2048D / 3600D END",
        "cells_per_deg(level INT) RETURNS DOUBLE RETURN CASE WHEN level_of(level) <= 15 THEN pow(2D, level - 9) ELSE 3600D * pow(2D, level - 21) END",
        f"equator_scale(level INT) RETURNS DOUBLE RETURN {EARTH_RADIUS * DEGREE!r}D * cell_deg(level)",
        f"height_layer_lower(layer BIGINT, level INT) RETURNS DOUBLE RETURN {EARTH_RADIUS!r}D * (pow({1.0 + DEGREE!r}D, CAST(layer AS DOUBLE) * cell_deg(level)) - 1D)",
        "height_cell(level INT) RETURNS DOUBLE RETURN height_layer_lower(1L, level)",
        "height_layer_bounds(layer BIGINT, level INT) RETURNS STRUCT<lower: DOUBLE, upper: DOUBLE> RETURN named_struct('lower', height_layer_lower(layer, level), 'upper', height_layer_lower(layer + 1, level))",
        f"height_index(h DOUBLE, level INT) RETURNS BIGINT RETURN CASE WHEN h > {-EARTH_RADIUS!r}D THEN CAST(floor(log1p(h / {EARTH_RADIUS!r}D) / {math.log1p(DEGREE)!r}D / cell_deg(level)) AS BIGINT) ELSE {refused('a height lies below the earth', 'BIGINT')} END",
        "height_layer_count(a DOUBLE, b DOUBLE, level INT) RETURNS BIGINT RETURN height_index(greatest(a, b), level) - height_index(least(a, b), level) + 1",
        "height_layer_bits(level INT, highest DOUBLE) RETURNS INT RETURN length(bin(greatest(0L, height_index(greatest(0D, highest), level))))",
        f"height_layer_fits(level INT, highest DOUBLE) RETURNS BOOLEAN RETURN height_layer_bits(level, highest) <= {WIDTHS['z']}",
        f"height_layer_valid(layer BIGINT) RETURNS BOOLEAN RETURN layer BETWEEN 0 AND {most}",
        f"max_supported_height(level INT) RETURNS DOUBLE RETURN height_layer_lower({most}L, level)",
        "encode_cell_at_height(x BIGINT, y BIGINT, level INT, height DOUBLE) RETURNS BIGINT RETURN cell_encode(x, y, height_index(height, level), CAST(level AS BIGINT), 0L, 0L)",
        "cell_height_interval(c BIGINT) RETURNS STRUCT<layer: INT, level: INT, lower: DOUBLE, upper: DOUBLE> RETURN named_struct('layer', cell_decode(c).z, 'level', cell_decode(c).level, 'lower', height_layer_lower(CAST(cell_decode(c).z AS BIGINT), cell_decode(c).level), 'upper', height_layer_lower(CAST(cell_decode(c).z AS BIGINT) + 1, cell_decode(c).level))",
        "toff_lenient(moment TIMESTAMP, origin TIMESTAMP) RETURNS BIGINT RETURN (unix_micros(moment) - unix_micros(origin) - pmod(unix_micros(moment) - unix_micros(origin), 60000000L)) div 60000000L",
        f"toff_strict(moment TIMESTAMP, origin TIMESTAMP) RETURNS BIGINT RETURN CASE WHEN moment >= origin THEN toff_lenient(moment, origin) ELSE {refused('a moment lies before the origin', 'BIGINT')} END",
        "node_is_aligned(toff BIGINT, lt INT) RETURNS BOOLEAN RETURN toff >= 0 AND lt >= 0 AND pmod(toff, shiftleft(1L, lt)) = 0",
        "node_end(toff BIGINT, lt INT) RETURNS BIGINT RETURN toff + shiftleft(1L, lt)",
        "node_span(toff BIGINT, lt INT) RETURNS STRUCT<start: BIGINT, end: BIGINT> RETURN named_struct('start', toff, 'end', node_end(toff, lt))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")
