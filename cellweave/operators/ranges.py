"""Order within groups that no single task can hold: range partitions, and sums of partitions carried over.

A window over a group sorts and scans the group in one task. A group of more than ``WHOLE`` rows is laid out in range
partitions instead, written once so that all steps see the same ones; what a row must know of the partitions before its own
is a sum or maximum over one row a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.scratch import stored

#: Rows of a group that one task orders at most.
WHOLE = 5_000_000
PART, AT = "_part", "_at"


def split_by_size(rows: DataFrame, group: str, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``whole`` rows, rows of the larger ones or None). Group ids are counted by a job of its own."""
    large = stored(rows.groupBy(F.col(group).alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > whole).select("_large"), "large")
    if large.isEmpty():
        return rows, None
    apart = lambda how: rows.join(large, F.col(group).eqNullSafe(F.col("_large")), how)
    return apart("left_anti"), apart("left_semi")


def laid_out(rows: DataFrame, group: str, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows in range partitions of (group, order), with the partition's number and the row's place over all of them (not
    dense). Rows that are equal in group and order may lie in any one partition, side by side."""
    spread = rows.repartitionByRange(partitions, F.col(group), *order) if partitions else rows.repartitionByRange(F.col(group), *order)
    placed = spread.sortWithinPartitions(F.col(group), *order).withColumn(AT, F.monotonically_increasing_id())
    return stored(placed.withColumn(PART, F.shiftright(AT, 33)), "laid")


def carried(rows: DataFrame, group: str, part: DataFrame, before: dict[str, Column], own: tuple = ()) -> DataFrame:
    """The rows with sums over the earlier partitions of their group, and columns of their own one. part: one row for each
    group and partition."""
    earlier = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.select(F.col(group).alias("_g"), F.col(PART).alias("_p"), *[c.over(earlier).alias(name) for name, c in before.items()], *own)
    return rows.join(sums, rows[group].eqNullSafe(F.col("_g")) & (rows[PART] == F.col("_p"))).drop("_g", "_p")


def ranked(rows: DataFrame, group: str, order: list[Column], rank: str = "rank", whole: int = WHOLE, partitions: int | None = None) -> DataFrame:
    """The rows with their rank (from 1) within their group by ``order``, as row_number gives it.

    Groups of at most ``whole`` rows are ranked by a window. Ties of larger ones are ranked in no particular order.
    """
    few, many = split_by_size(rows, group, whole)
    out = few.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    if many is None:
        return out
    laid = laid_out(many, group, order, partitions)
    part = laid.groupBy(group, PART).agg(F.count("*").alias("_n"), F.min(AT).alias("_low"))
    placed = carried(laid, group, part, {"_before": F.sum("_n")}, ("_low",)).withColumn(rank, F.col(AT) - F.col("_low") + F.coalesce("_before", F.lit(0)) + 1)
    return out.unionByName(placed.select(*rows.columns, rank))


def islands(spans: DataFrame, group: str, whole: int = WHOLE, partitions: int | None = None) -> DataFrame:
    """(group, start, end): spans that overlap or touch, merged.

    A sweep over a group's spans by start; in large groups each range partition begins with the greatest end before it.
    """
    spans = spans.select(group, "start", "end").distinct()
    few, many = split_by_size(spans, group, whole)

    def merged(rows: DataFrame, keys: list, carry: Column) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), carry)
        fresh = rows.withColumn("_fresh", F.coalesce((F.col("start") > reach).cast("bigint"), F.lit(1)))
        return fresh.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    bounds = lambda rows: rows.groupBy(group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
    out = bounds(merged(few, [group], F.lit(None).cast("bigint")))
    if many is None:
        return out
    laid = laid_out(many, group, [F.col("start"), F.col("end")], partitions)
    laid = carried(laid, group, laid.groupBy(group, PART).agg(F.max("end").alias("_reach")), {"_carry": F.max("_reach")})
    local = merged(laid, [group, PART], F.col("_carry"))
    # One row for each island of a partition; those that an earlier one began are joined with it by their number.
    local = local.groupBy(group, PART, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_fresh").alias("_fresh"))
    local = carried(local, group, local.groupBy(group, PART).agg(F.sum("_fresh").alias("_n")), {"_before": F.sum("_n")})
    return out.unionByName(bounds(local.withColumn("_island", F.col("_island") + F.coalesce("_before", F.lit(0)))))


# --- order statistics -------------------------------------------------------------------------------------------------

#: Value ranges into which a round of the selection counts.
CELLS = 4096


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], whole: int = WHOLE, also: list[Column] = ()) -> DataFrame:
    """(keys, q, also): the exact percentiles of a group's numbers, linearly interpolated as ``percentile`` does, as an array.
    also: other aggregates of the numbers, in column ``_v``.

    Nulls and NaN are left out, and groups without a number. Groups of at most ``whole`` numbers are one buffer each. Of
    larger ones only counts are aggregated: a round counts the numbers by equal ranges of value (``CELLS`` a range of the round before), and
    goes on within the ranges that hold a wanted rank, until one holds at most ``whole`` numbers or a single value.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # Large groups get a number, by which they are known from here on.
    large = stored(sizes.where(F.col("_n") > whole).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumn("_g", F.monotonically_increasing_id()), "large")
    exact = lambda r: r.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("q"), *also)
    if large.isEmpty():
        return exact(rows)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    many = rows.join(large, same).select("_g", "_v")
    place = F.col("_share") * (F.col("_n") - 1)
    asked = large.select("_g", "_n", "_low", "_high", F.posexplode(F.array(*map(F.lit, shares))).alias("_i", "_share")).withColumn("_place", place)
    ranks = asked.withColumn("_rank", F.explode(F.array(F.floor("_place"), F.ceil("_place"))))
    wanted = stored(ranks.select("_g", "_rank", "_low", "_high", F.lit(0).cast("bigint").alias("_before"), F.col("_n").alias("_held")).distinct(), "wanted")
    while not wanted.where((F.col("_held") > whole) & (F.col("_low") < F.col("_high"))).isEmpty():
        wanted = stored(_narrowed(many, wanted), "wanted")
    values = _values(many, wanted)
    low, high = (values.select("_g", F.col("_rank").alias(f"_{c}"), F.col("_x").alias(f"_{c}_x")) for c in ("below", "above"))
    at = asked.withColumn("_below", F.floor("_place")).withColumn("_above", F.ceil("_place")).join(low, ["_g", "_below"]).join(high, ["_g", "_above"])
    x = F.when(F.col("_below_x") == F.col("_above_x"), F.col("_below_x")).otherwise((F.col("_above") - F.col("_place")) * F.col("_below_x") + (F.col("_place") - F.col("_below")) * F.col("_above_x"))
    q = F.transform(F.sort_array(F.collect_list(F.struct("_i", x.alias("x")))), lambda s: s["x"])
    found = at.groupBy("_g").agg(q.alias("q"))
    more = exact(rows.join(large, same, "left_anti"))
    if also:
        found = found.join(many.groupBy("_g").agg(*also), "_g")
    found = found.join(large, "_g").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *more.columns[len(keys) :])
    return more.unionByName(found)


def _within(many: DataFrame, wanted: DataFrame) -> DataFrame:
    """The numbers in the ranges that hold a wanted rank, each with its range."""
    return many.join(wanted.select("_g", "_low", "_high").distinct(), "_g").where(F.col("_v").between(F.col("_low"), F.col("_high")))


def _narrowed(many: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ranks with the part of their range that holds them, by counts of ``CELLS`` equal parts."""
    # Halves, as the whole may be beyond a double; a half may be none at all. The ends of a range never share a part.
    width = F.col("_high") / 2 - F.col("_low") / 2
    cell = F.when(width > 0, F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / width * CELLS), F.lit(CELLS - 1))).otherwise((F.col("_v") > F.col("_low")).cast("int"))
    counts = _within(many, wanted).groupBy("_g", "_low", "_high", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_low", "_high").orderBy("_cell"))
    start = F.col("_before") + F.col("_upto") - F.col("_c")
    found = wanted.join(counts.withColumn("_upto", upto), ["_g", "_low", "_high"]).where((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_c")))
    return found.select("_g", "_rank", F.col("_first").alias("_low"), F.col("_last").alias("_high"), start.alias("_before"), F.col("_c").alias("_held"))


def _values(many: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_g, _rank, _x): the value of each wanted rank; a range that isn't a single value is sorted in one buffer."""
    one = wanted.where(F.col("_low") == F.col("_high")).select("_g", "_rank", F.col("_low").alias("_x"))
    rest = wanted.where(F.col("_low") < F.col("_high"))
    held = _within(many, rest).groupBy("_g", "_low", "_high").agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    return one.union(rest.join(held, ["_g", "_low", "_high"]).select("_g", "_rank", F.element_at("_values", (F.col("_rank") - F.col("_before") + 1).cast("int")).alias("_x")))
