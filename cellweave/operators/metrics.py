"""Distance joins over integer vectors, and weighted sums over long tables."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.operators.guards import guarded
from cellweave.operators.tasks import dealt, joined_in_place


#: Vectors on one side of a cell of pairs; fields that hold a vector's values for generated code, which takes 100 in all, while arrays
#: are gone through by interpreted functions; bits of a digit where a field holds two values.
CELL_ROWS, FIELDS, DIGIT = 4096, 32, 18


def _value(k: int) -> Column:
    return F.coalesce(F.get("values", F.lit(k)).cast("bigint"), F.lit(0).cast("bigint"))


def _compared(lo: int, hi: int, longest: int):
    """(columns of a side by its name, tests of a pair of sides, its l2) for vectors of at most ``longest`` values from lo to hi.

    Small values go two a field: (x0 + x1 * D)(y1 + y0 * D), with D = 2^18, has x0 * y0 + x1 * y1 as its middle digit, and a sum of such
    products keeps its digits apart, and is exact as a double, while the products of a digit add up to less than 2^17. Then l2 is
    x^2 + y^2 - 2xy. Doubles, as sums of BIGINT are checked one by one, which takes longer than the sums. Larger values go one a
    field, as BIGINT. What has no field stays in arrays, which are compared if the fields are near enough.
    """
    a_sum = ((1 << DIGIT - 1) - 1) // max(1, hi - lo) ** 2
    n = min(longest, 2 * FIELDS if a_sum else FIELDS)
    names = [f"w{k}" for k in range((n + 1) // 2 if a_sum else n)]
    small = lambda k: F.when(F.col("n") > k, _value(k) - F.lit(lo)).otherwise(0).cast("double") if k < n else F.lit(0.0)
    total = lambda terms, zero: functools.reduce(lambda x, y: x + y, terms, zero)

    def columns(side: str) -> list[Column]:
        first = 0 if side == "left" else 1
        words = [small(2 * k + first) + small(2 * k + 1 - first) * float(1 << DIGIT) for k in range(len(names))] if a_sum else map(_value, range(n))
        squares = F.aggregate(F.slice("values", 1, max(n, 1)), F.lit(0.0), lambda s, x: s + (x - F.lit(lo)).cast("double") * (x - F.lit(lo)).cast("double"))
        rest = [F.slice("values", n + 1, longest).alias(f"{side}_rest")] if longest > n else []
        return [*[w.alias(f"{side}_{name}") for w, name in zip(words, names)], *([squares.alias(f"{side}_squares")] if a_sum else []), *rest]

    left, right = ([F.col(f"{side}_{name}") for name in names] for side in ("left", "right"))
    if a_sum:
        middle = lambda s: F.floor(s * 0.5**DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("double")
        sums = [total((x * y for x, y in zip(left[k : k + a_sum], right[k : k + a_sum])), F.lit(0.0)) for k in range(0, len(names), a_sum)]
        l2 = F.col("left_squares") + F.col("right_squares") - total(map(middle, sums), F.lit(0.0)) * 2.0
    else:
        l2 = total(((x - y) * (x - y) for x, y in zip(left, right)), F.lit(0).cast("bigint"))
    whole = l2.cast("bigint") + codes.l2_squared("left_rest", "right_rest") if longest > n else l2
    return columns, [l2, whole] if longest > n else [l2], whole.cast("bigint")


def pairs_within_distance(vectors: DataFrame, threshold: int, dims: int = 2, group: str | None = None, cell: int = CELL_ROWS) -> DataFrame:
    """(left_id, right_id, l2) of all pairs within the threshold, each once. Rows: (vec_id, values) and a group to stay in.

    The first ``dims`` coordinates are cut into buckets as wide as the threshold, so near pairs lie in neighbouring buckets:
    an equality join with an exact test, never a product of the table with itself. A bucket and those it meets are dealt into
    cells of about ``cell`` vectors on either side, so a popular bucket is the work of many tasks. Vectors of different lengths are
    not compared, and those with a missing value are near to none.
    """
    joined_in_place(vectors)
    width = max(1, abs(int(threshold)))
    spots = [f"b{k}" for k in range(dims)]
    keys = [*spots, "n", *(["group"] if group else [])]
    floor = lambda v: F.call_function("div", v, F.lit(width)) - F.when(F.pmod(v, F.lit(width)) != v % width, 1).otherwise(0)
    whole = vectors.where(F.col("vec_id").isNotNull() & F.forall("values", lambda x: x.isNotNull()))
    placed = whole.select("vec_id", "values", *([F.col(group).alias("group")] if group else []), F.size("values").alias("n"), *[floor(_value(k)).alias(b) for k, b in enumerate(spots)])
    # The bucket itself and half of its neighbours: the other half meets it from its own side.
    steps = [s for s in itertools.product((-1, 0, 1), repeat=dims) if s >= (0,) * dims]
    step = F.explode(F.array(*[F.struct(F.lit(not any(s)).alias("own"), *[F.lit(x).cast("bigint").alias(b) for x, b in zip(s, spots)]) for s in steps]))
    met = lambda rows: rows.withColumn("step", step).withColumns({b: F.col(b) - F.col(f"step.{b}") for b in spots}).withColumn("own", F.col("step.own")).drop("step")
    held = placed.groupBy(*keys).agg(F.count("*").alias("l"), F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
    sizes = held.join(met(held.select(*keys, F.col("l").alias("r"))).groupBy(*keys).agg(F.sum("r").alias("r")), keys)
    plan = sizes.agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("pairs"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    columns, tests, l2 = _compared(plan["lo"] or 0, plan["hi"] or 0, plan["n"] or 0)
    sides = sizes.select(*keys, *[F.ceil(F.col(c) / cell).alias(f"{c}_parts") for c in ("l", "r")])
    part = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(f"{c}_parts")).alias(c)
    along = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{c}_parts") - 1)).alias(c)
    lay = lambda rows: dealt(rows.drop("l_parts", "r_parts"), plan["pairs"] or 0, *keys, "l", "r")
    left = lay(placed.select("vec_id", *keys, *columns("left")).join(sides, keys).select("*", part("l"), along("r")))
    right = lay(met(placed.select("vec_id", *keys, *columns("right"))).join(sides, keys).select("*", along("l"), part("r")).withColumnRenamed("vec_id", "right_id"))
    found = left.join(right, [*keys, "l", "r"]).where(F.when(F.col("own"), F.col("vec_id") < F.col("right_id")).otherwise(F.col("vec_id") != F.col("right_id")))
    for test in tests:
        found = found.where(test <= (width * width if threshold else 0))
    return found.select(F.least("vec_id", "right_id").alias("left_id"), F.greatest("vec_id", "right_id").alias("right_id"), l2.alias("l2"))


def pair_distances(pairs: DataFrame, vectors: DataFrame, threshold: int) -> DataFrame:
    """(left_id, right_id, l2, near) of listed pairs: two equality joins on the vectors' ids."""
    left = vectors.select(F.col("vec_id").alias("left_id"), "values")
    right = vectors.select(F.col("vec_id").alias("right_id"), F.col("values").alias("right_values"))
    found = pairs.join(left, "left_id").join(right, "right_id").withColumn("l2", codes.l2_squared("values", "right_values"))
    return found.select("left_id", "right_id", "l2", codes.distance_le("values", "right_values", threshold).alias("near"))


def pair_distances_long(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(left_id, right_id, l2) of listed pairs of wide vectors, given as rows (vec_id, dim, value), one for each dimension.

    The squares are added up by pair as DECIMAL(38,0), so a sum beyond BIGINT is exact (beyond 38 digits it fails the job). No row
    holds a vector. A dimension that one side of a pair lacks, or holds no value in, fails the job. A pair whose ids are both
    unknown has no row.
    """
    wide = F.col("value").cast("decimal(20,0)")
    side = lambda s: pairs.select("left_id", "right_id").distinct().join(values.select(F.col("vec_id").alias(f"{s}_id"), "dim", wide.alias(s)), f"{s}_id")
    both = side("left").join(side("right"), ["left_id", "right_id", "dim"], "full")
    gap = F.col("left") - F.col("right")
    found = both.groupBy("left_id", "right_id").agg(F.sum((gap * gap).cast("decimal(38,0)")).alias("l2"))
    return guarded(found, both.agg(F.count_if(gap.isNull()).alias("bad")), "vectors differ in their dimensions")


def weighted_sum_long(values: DataFrame, weights: DataFrame, scale: int = 1, exact: bool = False) -> DataFrame:
    """(vec_id, score) for rows (vec_id, dim, value) and weights (dim, weight); a dimension without a weight is left out.

    ``exact``: totals and scores are DECIMAL(38,0), for sums beyond BIGINT (scores of at most 32 digits); else such a sum fails the job.
    """
    number = (lambda c: F.col(c).cast("decimal(19,0)")) if exact else F.col
    joined = values.join(weights, "dim").groupBy("vec_id").agg(F.sum(number("value") * number("weight")).alias("total"))
    if not exact:
        return joined.select("vec_id", codes.floor_div(F.col("total"), scale).alias("score"))
    total, by = F.col("total").cast("decimal(38,0)"), F.lit(scale).cast("decimal(19,0)")
    return joined.select("vec_id", ((total - F.pmod(total, by)) / by).cast("decimal(38,0)").alias("score"))


def vector_guards(vectors: DataFrame) -> DataFrame:
    """Rows with ``valid``: no element missing and a positive scale."""
    return vectors.withColumn("valid", codes.vector_is_valid("values", "scale"))
