"""Set joins and preparation for tables of cell sets ``(set_id, grid_code)``.

All operators take whole tables of sets. Joins go by grid code, so a popular cell is a skewed key that adaptive execution
splits. Pairs are counted by right set: a code's left sets travel to it as one array, and tasks are as many as the pairs need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce, wraps
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cellweave.functions import codes
from cellweave.operators import bits
from cellweave.operators.guards import guarded
from cellweave.operators.tasks import MOST, TASK_ROWS, dealt, joined_in_place, least_tasks
from cellweave.operators.ranges import WHOLE, ranked
from cellweave.sources.cells import layout_mismatches
from cellweave.sources.scratch import stored

#: Ids of a code that one row holds.
PACKED_IDS = 4096
#: Pairs of one right set that one task counts; sets with more are counted by pair.
SET_PAIRS = 10 * TASK_ROWS
#: Codes are held by many sets if each is held by one of this many on average.
HELD_OFTEN = 400
#: Rows of words that one task holds, thrice, and the rows that pass through them, a slab each.
CELL_CODES = 1_200_000
PASSED_ROWS = 200_000_000


def prepare_cells(cells: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(set_id, grid_code, rank, input_count, unique_count, duplicate_count): each set's distinct codes ranked in unsigned
    order, with its counts. A set of more than ``whole`` codes is ranked in range partitions."""
    by_code = cells.groupBy("set_id", "grid_code").agg(F.count("*").alias("n"))
    counts = by_code.groupBy("set_id").agg(F.sum("n").alias("input_count"), F.count("*").alias("unique_count"))
    counts = counts.withColumnRenamed("set_id", "counted_id")
    placed = ranked(by_code, "set_id", codes.unsigned_order("grid_code"), whole=whole)
    return placed.join(counts, F.col("set_id").eqNullSafe(F.col("counted_id"))).select("set_id", "grid_code", "rank", "input_count", "unique_count", (F.col("input_count") - F.col("unique_count")).alias("duplicate_count"))


def prepared(cells: DataFrame) -> DataFrame:
    """Distinct (set_id, grid_code)."""
    return cells.select("set_id", "grid_code").distinct()


def gated(f):
    """Adds ``layouts`` to a set operator: the manifests that its tables declare (None: not declared), in their order. Manifests
    that differ are refused before any job: codes of two layouts may meet and yet mean different cells."""

    @wraps(f)
    def run(*args, layouts: tuple[Mapping | None, ...] = (), **more):
        for a, b in combinations(layouts, 2):
            differ = layout_mismatches(a, b)
            if differ:
                raise ValueError(f"the tables' layouts differ in {', '.join(differ)}")
        return f(*args, **more)

    return run


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each pair of sets and code that both hold."""
    a = prepared(left).select(F.col("set_id").alias("left_id"), "grid_code")
    b = prepared(right).select(F.col("set_id").alias("right_id"), "grid_code")
    return a.join(b, "grid_code")


def _packed(cells: DataFrame, name: str, most: int) -> DataFrame:
    """(grid_code, name): the distinct sets that hold a code, some ``PACKED_IDS`` in an array. most: rows of the most popular code."""
    rows = cells.select("set_id", "grid_code")
    part = F.lit(0)
    if most > PACKED_IDS:
        popular = cells.groupBy("grid_code").agg(F.count("*").alias("held")).where(F.col("held") > PACKED_IDS)
        rows = rows.join(popular, "grid_code", "left")
        part = F.coalesce(F.pmod(F.xxhash64("set_id"), F.ceil(F.col("held") / PACKED_IDS)), F.lit(0))
    # Arrays are collected without nulls, so a null id is an array of its own.
    ids = rows.groupBy("grid_code", part.alias("part"), F.col("set_id").isNull().alias("nil")).agg(F.collect_set("set_id").alias("ids"))
    return ids.select("grid_code", F.when(F.col("nil"), F.array(F.lit(None).cast(cells.schema["set_id"].dataType))).otherwise(F.col("ids")).alias(name))


def _coded(cells: DataFrame, name: str) -> tuple[Column, Callable[[DataFrame, str], DataFrame]] | None:
    """How arrays of whole-number ids travel when their range is small: the array (sorted) as bytes of its ids' distances from the least,
    two low ones and the others apart (struct<low, high>; the high ones repeat and compress), and what gives the rows' ids back. None: as
    they are.
    """
    kind = cells.schema["set_id"].dataType
    least, most = cells.agg(F.min("set_id"), F.max("set_id")).first() if isinstance(kind, IntegralType) else (None, None)
    if least is None or most - least >= 1 << 32:
        return None
    high = "tinyint" if most - least < 1 << 24 else "smallint"
    half = 128 if high == "tinyint" else 32768
    far = lambda x: x.cast("bigint") - F.lit(least)
    sorted_ids = F.sort_array(name)
    low = F.transform(sorted_ids, lambda x: (far(x).bitwiseAND(F.lit(65535)) - 32768).cast("smallint"))
    array = F.struct(low.alias("low"), F.transform(sorted_ids, lambda x: (F.shiftright(far(x), 16) - half).cast(high)).alias("high"))

    def ids(rows: DataFrame, name: str) -> DataFrame:
        keep = [c for c in rows.columns if c != name]
        rows = rows.select(*keep, F.col(name)["high"].alias("_high"), F.posexplode(F.col(name)["low"]).alias("_at", "_low"))
        whole = (F.get("_high", F.col("_at")).cast("bigint") + half) * 65536 + F.col("_low").cast("bigint") + 32768 + F.lit(least)
        return rows.select(*keep, whole.cast(kind).alias(name))

    return array, ids


def _met(right: DataFrame, others: dict[str, DataFrame], sums: list, values: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """(right_id, the others' ids, sums) of sets that share a code; ``others``: tables by the name of their id.

    A right set's codes come together with arrays of the sets that hold them, so a pair is a few bytes until its task counts it.
    A right set of very many pairs is counted by pair instead. values: (grid_code, value), which the sums may use.
    """
    keys = [*others, "right_id"]
    rights = prepared(right).select(F.col("set_id").alias("right_id"), "grid_code")
    counts = [(name, cells.groupBy("grid_code").agg(F.count("*").alias(f"{name}_held"))) for name, cells in others.items()]
    load = F.lit(1.0)
    for name, _ in counts:
        load = load * F.col(f"{name}_held")
    # By code and by set, without bringing sets to their codes: the largest set's pairs are bounded first.
    loads = right.groupBy("grid_code").agg(F.count("*").alias("right_held"))
    for _, n in counts:
        loads = loads.join(n, "grid_code")
    plan = loads.agg(F.sum(load * F.col("right_held")).alias("all"), F.max(load).alias("most"), *[F.max(f"{name}_held").alias(name) for name, _ in counts]).first()
    largest = (plan["most"] or 0) * (right.groupBy("set_id").count().agg(F.max("count")).first()[0] or 0)
    if largest > SET_PAIRS:
        loads = rights
        for _, n in counts:
            loads = loads.join(n, "grid_code")
        loads = loads.groupBy("right_id").agg(F.sum(load).alias("load"))
        largest = loads.agg(F.max("load")).first()[0] or 0
    rows = rights
    coded = {name: None if ordered else _coded(cells, name) for name, cells in others.items()}
    for name, cells in others.items():
        held = _packed(cells, name, plan[name] or 0)
        rows = rows.join(held.withColumn(name, coded[name][0]) if coded[name] else held, "grid_code")
    if values is not None:
        rows = rows.join(values, "grid_code")
    if ordered:
        rows = rows.withColumn("left_id", F.filter("left_id", lambda x: x < F.col("right_id"))).where(F.size("left_id") > 0)
    rows = rows.drop("grid_code")

    def counted(some):
        for name in others:
            some = coded[name][1](some, name) if coded[name] else some.withColumn(name, F.explode(name))
        return some.groupBy(*keys).agg(*sums)

    if largest <= SET_PAIRS:
        return counted(dealt(rows, plan["all"] or 0, "right_id"))
    large = loads.where(F.col("load") > SET_PAIRS).select(F.col("right_id").alias("large_id"))
    apart = lambda how: rows.join(large, F.col("right_id").eqNullSafe(F.col("large_id")), how)
    return counted(dealt(apart("left_anti"), plan["all"], "right_id")).unionByName(counted(apart("left_semi")))


@gated
def intersects_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, intersects: whether two cell sets (one pair) have a code in common. The search ends at the first one."""
    common = left.select("grid_code").join(right.select("grid_code"), "grid_code", "left_semi")
    return common.limit(1).agg((F.count("*") > 0).alias("intersects"))


@gated
def contains_row(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """One row, contains: whether outer holds all of inner; the empty set is in every set."""
    lone = inner.select("grid_code").join(outer.select("grid_code"), "grid_code", "left_anti")
    return lone.limit(1).agg((F.count("*") == 0).alias("contains"))


@gated
def intersects(left: DataFrame, right: DataFrame) -> bool:
    return intersects_row(left, right).first()[0]


@gated
def contains(outer: DataFrame, inner: DataFrame) -> bool:
    return contains_row(outer, inner).first()[0]


@gated
def intersecting_pairs(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """(left_id, right_id, overlap) for each pair with a common code; ``ordered``: a table with itself, each pair once."""
    return _met(right, {"left_id": left}, [F.count("*").alias("overlap")], ordered=ordered).select("left_id", "right_id", "overlap")


@gated
def cellset_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, grid_code): the common codes of each pair."""
    return _shared(left, right).select("left_id", "right_id", "grid_code")


@gated
def intersect_bodies(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row a pair, with its common codes in unsigned order; a row holds one pair's intersection."""
    key = lambda c: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(codes.unsigned_order(c))), c.alias("code"))
    body = F.transform(F.array_sort(F.collect_list(key(F.col("grid_code")))), lambda s: s["code"])
    return _shared(left, right).groupBy("left_id", "right_id").agg(body.alias("codes"))


def cardinality(cells: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(set_id, n_codes, is_empty); with ``ids``, sets without a cell appear too."""
    n = prepared(cells).groupBy("set_id").agg(F.count("*").alias("n_codes"))
    n = n if ids is None else ids.select("set_id").distinct().join(n, "set_id", "left").fillna(0, ["n_codes"])
    return n.withColumn("is_empty", F.col("n_codes") == 0)


def _holding_both(wanted: DataFrame, whole: DataFrame, rows: int) -> DataFrame:
    """(left_id, right_id, n_codes) of the sets in whole (left_id, grid_code; so many rows) that hold both codes of wanted (right_id, first,
    second, n_codes).

    A triangle of joins: sets, first and second codes are hashed to the sides of a cube, each table is copied along the side that it
    lacks, and each cell of the cube joins its own rows. So no pair that holds the first code alone is shuffled.
    """
    joined_in_place(whole)
    side = math.ceil((rows / TASK_ROWS) ** 0.5) or 1
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    along = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(side - 1).cast("bigint")))
    cell = lambda x, y, z: ((x * side + y) * side + z).alias("cell")
    placed = lambda rows: dealt(rows, 4 * side**3 * TASK_ROWS, "cell")
    wanted = placed(wanted.withColumn("along", along).select("right_id", "first", "second", "n_codes", cell(F.col("along"), spot("first"), spot("second"))))
    sets = whole.withColumn("along", along)
    holds_first = placed(sets.select(F.col("left_id").alias("one_id"), F.col("grid_code").alias("first"), cell(spot("left_id"), spot("grid_code"), F.col("along"))))
    holds_second = placed(sets.select(F.col("left_id").alias("one_id"), F.col("grid_code").alias("second"), cell(spot("left_id"), F.col("along"), spot("grid_code"))))
    found = wanted.join(holds_first, ["cell", "first"]).join(holds_second.hint("shuffle_hash"), ["cell", "one_id", "second"])
    return found.select(F.col("one_id").alias("left_id"), "right_id", "n_codes")


def _holding_by_bits(wanted: DataFrame, whole: DataFrame, rows: int, sets: int, kinds: int, names: list[str]) -> DataFrame:
    """(left_id, right_id, n_codes) of the sets in whole (left_id, grid_code) that hold the codes called names of wanted (right_id, names,
    n_codes), where codes are held by many sets. rows, sets, kinds: how many rows, sets and codes are in whole.

    A code's sets are rows of bits, and a wanted row keeps the bits that its codes have in common. A cell has a number of slabs of
    sets, as many as its rows of words allow (``CELL_CODES``), and some of the wanted rows, which pass through it. So wanted rows are
    copied once for each bundle of slabs, and no task holds pairs.
    """
    joined_in_place(whole)
    seats = bits.SEATS if kinds <= CELL_CODES else min(bits.SEATS, max(1, CELL_CODES * sets // rows))
    slabs = math.ceil(sets / seats)
    least = least_tasks(whole.sparkSession)
    wide = max(1, min(CELL_CODES // min(kinds, max(1, rows * seats // sets)), round(slabs / least**0.5)))
    bundles = math.ceil(slabs / wide)
    parts = max(1, math.ceil(max(least, wanted.count() * slabs / PASSED_ROWS) / bundles))
    placed = lambda rows: rows.repartitionById(bundles * parts, "cell") if bundles * parts <= MOST else rows.repartition(MOST, "cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("bundle") * parts + F.col("part")).alias("cell")
    seated = bits.seated(whole.select("left_id"), slabs, "left_id")
    copied = lambda rows: rows.withColumn("bundle", F.floor(F.col("slab") / wide).cast("int")).withColumn("part", each(parts))
    held = whole.groupBy("left_id").agg(F.sort_array(F.collect_list("grid_code")).alias("held")).join(seated, "left_id")
    lists = placed(copied(seated).select(cell, "slab", "page", "seat", "left_id")).groupBy("cell", "slab", "page").agg(bits.listed("left_id"))
    slab = ["cell", "slab", "page"]
    holders = bits.gathered(placed(copied(held).select(cell, "slab", "page", "seat", "held")).select(*slab, "seat", F.explode("held").alias("code")), *slab, "code")
    met = placed(wanted.withColumn("part", F.pmod(F.xxhash64("right_id"), F.lit(parts)).cast("int")).withColumn("bundle", each(bundles)).select(cell, "right_id", "n_codes", *names))
    for k, name in enumerate(names):
        rows = holders.select(*slab, F.col("code").alias(name), *[F.col(w).alias(f"more_{w}") for w in bits.NAMES]).hint("shuffle_hash")
        words = [(F.col(w).bitwiseAND(F.col(f"more_{w}")) if k else F.col(f"more_{w}")).alias(w) for w in bits.NAMES]
        met = met.join(rows, [*(slab if k else ["cell"]), name]).select(*slab, "right_id", "n_codes", *names[k + 1 :], *words)
        # Not deterministic, or the optimizer derives conditions from it for each choice of the words' names.
        met = met.where((F.monotonically_increasing_id() < 0) | (reduce(lambda x, y: x.bitwiseOR(y), map(F.col, bits.NAMES)) != 0))
    return bits.unseated(met.join(lists.hint("shuffle_hash"), slab), "left_id", "right_id", "n_codes").select("left_id", "right_id", "n_codes")


@gated
def containing_pairs(outer: DataFrame, inner: DataFrame, outer_ids: DataFrame | None = None, inner_ids: DataFrame | None = None) -> DataFrame:
    """(outer_id, inner_id) of each inner set whose codes are all in the outer one.

    An inner set of one code is in all sets that hold it. Of larger ones the two or three rarest codes decide first (``_holding_both``,
    ``_holding_by_bits``); a pair that is left and has more codes qualifies if it shares as many as the inner set has. Empty inner sets, known by
    ``inner_ids`` only, are in every outer set; pairing them is the result itself.
    """
    whole = prepared(outer).select(F.col("set_id").alias("left_id"), "grid_code").where("left_id is not null and grid_code is not null")
    large = outer.count() > TASK_ROWS
    # Used several times, so a large one is written once instead of shuffled each time.
    whole = stored(whole, "outer") if large else whole
    part = prepared(inner).select(F.col("set_id").alias("right_id"), "grid_code").where("right_id is not null")
    spread = whole.groupBy("grid_code").agg(F.count("*").alias("held_by"))
    each = Window.partitionBy("right_id")
    place = F.row_number().over(each.orderBy(F.coalesce("held_by", F.lit(0)), "grid_code"))
    rare = part.join(spread, "grid_code", "left").withColumn("place", place).withColumn("n_codes", F.count("*").over(each)).where("place <= 3")
    rare = rare.groupBy("right_id", "n_codes").agg(*[F.max(F.when(F.col("place") == k, F.col("grid_code"))).alias(c) for k, c in ((1, "first"), (2, "second"), (3, "third"))])
    rare = stored(rare, "inner") if large else rare
    lone = rare.where("second is null").join(whole, F.col("first") == F.col("grid_code")).select("left_id", "right_id")
    rows, wanted = whole.count(), rare.where("second is not null")
    sets, kinds = (whole.select(c).distinct().count() for c in ("left_id", "grid_code")) if large else (0, 0)
    if rows * HELD_OFTEN > sets * kinds > 0:
        # Apart, so that either is computed once.
        both, more = (_holding_by_bits(wanted.where(which), whole, rows, sets, kinds, names) for which, names in (("n_codes = 2", ["first", "second"]), ("n_codes > 2", ["first", "second", "third"])))
    else:
        both = _holding_both(wanted, whole, rows)
        both, more = both.where("n_codes = 2"), both.where("n_codes > 2")
    more = more.join(part, "right_id").join(whole, ["left_id", "grid_code"]).groupBy("left_id", "right_id", "n_codes").agg(F.count("*").alias("overlap"))
    found = lone.union(both.select("left_id", "right_id")).union(more.where("overlap = n_codes").select("left_id", "right_id"))
    found = found.select(F.col("left_id").alias("outer_id"), F.col("right_id").alias("inner_id"))
    if inner_ids is None:
        return found
    empty = inner_ids.select("set_id").distinct().join(inner.select("set_id"), "set_id", "left_anti").select(F.col("set_id").alias("inner_id"))
    outers = (outer if outer_ids is None else outer_ids).select(F.col("set_id").alias("outer_id")).distinct()
    return found.union(outers.join(empty, F.lit(True)).select("outer_id", "inner_id"))


@gated
def containing_pairs_compact(outer: DataFrame, inner: DataFrame, inner_ids: DataFrame) -> DataFrame:
    """(outer_id, inner_id, every_outer): ``containing_pairs``, with one row for an empty inner set instead of one for each outer
    set: its outer_id is null and every_outer is true."""
    some = containing_pairs(outer, inner).select("outer_id", "inner_id", F.lit(False).alias("every_outer"))
    empty = inner_ids.select("set_id").distinct().join(inner.select("set_id"), "set_id", "left_anti")
    return some.union(empty.select(F.lit(None).cast(some.schema["outer_id"].dataType).alias("outer_id"), F.col("set_id").alias("inner_id"), F.lit(True).alias("every_outer")))


@gated
def chain_intersect(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """(left_id, right_id, third_id, overlap): pairs' intersections tested against a third table of sets."""
    found = _met(second, {"left_id": first, "third_id": third}, [F.count("*").alias("overlap")])
    return found.select("left_id", "right_id", "third_id", "overlap")


@gated
def intersection_count(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, n) for listed pairs; 0 for those without a common code."""
    wanted = pairs.select("left_id", "right_id").distinct()
    # From the listed pairs to their left codes, then to the right ones: no other pair is ever made.
    a = prepared(left).select(F.col("set_id").alias("left_id"), "grid_code")
    b = prepared(right).select(F.col("set_id").alias("right_id"), "grid_code")
    n = wanted.join(a, "left_id").join(b, ["right_id", "grid_code"]).groupBy("left_id", "right_id").agg(F.count("*").alias("n"))
    return wanted.join(n, ["left_id", "right_id"], "left").select("left_id", "right_id", F.coalesce("n", F.lit(0)).alias("n"))


def weights_missing(left: DataFrame, weights: DataFrame) -> DataFrame:
    """(grid_code, reason) of codes without a value, or with one that is negative."""
    need = left.select("grid_code").distinct()
    have = weights.groupBy("grid_code").agg(F.max("value").alias("value"))
    found = need.join(have, "grid_code", "left")
    reason = F.when(F.col("value").isNull(), "missing").when(F.col("value") < 0, "out of range")
    return found.withColumn("reason", reason).where("reason is not null").select("grid_code", "reason")


@gated
def intersection_sum(left: DataFrame, right: DataFrame, weights: DataFrame, check: bool = True) -> DataFrame:
    """(left_id, right_id, n, total): common codes and the sum of the left codes' weights.

    Every left code needs a weight; with ``check``, a missing or negative one fails the job, whatever the right sets are and
    whichever rows and columns of the result are used. Of several weights of a code the greatest counts. A sum beyond BIGINT
    fails the job.
    """
    held = weights.groupBy("grid_code").agg(F.max("value").cast("bigint").alias("value"))
    sums = _met(right, {"left_id": left}, [F.count("*").alias("n"), F.sum("value").alias("total")], held.where("value is not null"))
    sums = sums.select("left_id", "right_id", "n", "total")
    if not check:
        return sums
    valued = left.select("grid_code").distinct().join(held, "grid_code", "left")
    bad = valued.agg(F.count_if(~F.coalesce(F.col("value") >= 0, F.lit(False))).alias("bad"))
    return guarded(sums, bad, "some codes have no valid weight")


# --- preparation ----------------------------------------------------------------------------------------------------


def sort_cells(cells: DataFrame) -> DataFrame:
    """Rows in the order of unsigned codes, duplicates kept."""
    return cells.orderBy(*codes.unsigned_order("grid_code"))


def dedup_first_seen(cells: DataFrame, position: str = "pos", whole: int = WHOLE) -> DataFrame:
    """(set_id, grid_code, pos, rank): each code at its first position, ranked by it (then by code) within its set. A set of
    more than ``whole`` codes is ranked in range partitions."""
    first = cells.groupBy("set_id", "grid_code").agg(F.min(position).alias("pos"))
    return ranked(first, "set_id", [F.col("pos"), F.col("grid_code")], whole=whole)


def duplicate_stats(cells: DataFrame) -> DataFrame:
    """(set_id, n_rows, n_unique, n_duplicates)."""
    by_code = cells.groupBy("set_id", "grid_code").agg(F.count("*").alias("n"))
    return by_code.groupBy("set_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique"))


def set_fingerprint(cells: DataFrame) -> DataFrame:
    """(set_id, fingerprint): first 16 hex digits of SHA-256 over the sorted distinct codes, big-endian. A row holds one set."""
    text = F.array_join(F.array_sort(F.collect_set(F.lpad(F.hex("grid_code"), 16, "0"))), "")
    return cells.groupBy("set_id").agg(F.substring(F.sha2(F.unhex(text), 256), 1, 16).alias("fingerprint"))


def set_fingerprint_tree(cells: DataFrame) -> DataFrame:
    """(set_id, fingerprint): SHA-256 of a hash tree over a set's distinct codes, for sets of any size.

    A leaf is the hash of the codes that share their upper 48 bits: their lower 16 bits in order, big-endian. A node above is
    the hash of its children in order, each its own 16 bits and its hash; four levels lead to the set. A row holds at most
    65,536 children. The result doesn't depend on partitions; it isn't ``set_fingerprint``'s.
    """
    node = prepared(cells).select("set_id", F.shiftrightunsigned("grid_code", 16).alias("up"), F.lpad(F.hex(F.col("grid_code").bitwiseAND(F.lit(65535))), 4, "0").alias("entry"))
    for _ in range(4):
        joined = F.sha2(F.unhex(F.array_join(F.array_sort(F.collect_list("entry")), "")), 256)
        node = node.groupBy("set_id", "up").agg(joined.alias("hash"))
        part = F.lpad(F.hex(F.col("up").bitwiseAND(F.lit(65535))), 4, "0")
        node = node.select("set_id", F.shiftrightunsigned("up", 16).alias("up"), F.concat(part, F.upper("hash")).alias("entry"), "hash")
    return node.select("set_id", F.col("hash").alias("fingerprint"))


def prefix_groups(cells: DataFrame) -> DataFrame:
    """(set_id, top, shared_bytes, prefix, n, suffixes): codes of one top byte, their common leading bytes cut off."""
    key = lambda c: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(codes.unsigned_order(c))), c.alias("code"))
    grouped = prepared(cells).withColumn("top", F.shiftrightunsigned("grid_code", 56)).groupBy("set_id", "top")
    grouped = grouped.agg(F.min("grid_code").alias("low"), F.max("grid_code").alias("high"), F.count("*").alias("n"), F.array_sort(F.collect_list(key(F.col("grid_code")))).alias("sorted"))
    differ = F.col("low").bitwiseXOR(F.col("high"))
    shared = F.when(differ == 0, 0).otherwise(F.call_function("div", 64 - F.length(F.bin(differ)), F.lit(8))).cast("int")
    grouped = grouped.withColumn("shared_bytes", shared)
    bits = 8 * (8 - F.col("shared_bytes"))
    grouped = grouped.withColumn("prefix", F.when(F.col("shared_bytes") == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.col("low"), bits)))
    mask = F.when(F.col("shared_bytes") == 0, F.lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    return grouped.withColumn("mask", mask).select("set_id", "top", "shared_bytes", "prefix", "n", F.transform("sorted", lambda s: s["code"].bitwiseAND(F.col("mask"))).alias("suffixes"))


def compression_sizes(groups: DataFrame) -> DataFrame:
    """(set_id, n_codes, n_groups, raw_bytes, compressed_bytes) of prefix groups."""
    return groups.groupBy("set_id").agg(F.sum("n").alias("n_codes"), F.count("*").alias("n_groups"), (8 * F.sum("n")).alias("raw_bytes"), F.sum(8 + F.col("n") * (8 - F.col("shared_bytes"))).alias("compressed_bytes"))


def expand_prefix_groups(groups: DataFrame) -> DataFrame:
    """(set_id, grid_code) from prefix groups: the inverse of ``prefix_groups``."""
    whole = F.when(F.col("shared_bytes") == 0, F.col("suffix")).otherwise(F.call_function("shiftleft", F.col("prefix"), 8 * (8 - F.col("shared_bytes"))).bitwiseOR(F.col("suffix")))
    return groups.withColumn("suffix", F.explode("suffixes")).select("set_id", whole.alias("grid_code"))


def bucket_of(code, buckets: int):
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    bits = buckets.bit_length() - 1
    return F.shiftrightunsigned(F.col(code), 64 - bits).cast("int") if bits else F.lit(0)


def prefix_buckets(cells: DataFrame, buckets: int = 16) -> DataFrame:
    """(bucket, n): distinct codes by their top bits, empty buckets listed."""
    n = cells.select("grid_code").distinct().groupBy(bucket_of("grid_code", buckets).alias("bucket")).agg(F.count("*").alias("n"))
    every = cells.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(n), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def recheck_pair_stats(pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """Counts of a generated pair table (pair_id, side, grid_code) against the declared ones."""
    # As many tasks as the rows need, before any is counted: a small table can generate many rows in one task.
    by_side = dealt(pairs, pairs.count(), "pair_id", "grid_code").groupBy("pair_id", "grid_code").agg(F.count(F.when(F.col("side") == "left", 1)).alias("l"), F.count(F.when(F.col("side") == "right", 1)).alias("r"))
    found = by_side.groupBy("pair_id").agg(
        F.count(F.when(F.col("l") > 0, 1)).alias("n_left_unique"),
        F.count(F.when(F.col("r") > 0, 1)).alias("n_right_unique"),
        F.count(F.when((F.col("l") > 0) & (F.col("r") > 0), 1)).alias("n_overlap"),
        F.sum(F.greatest(F.col("l") - 1, F.lit(0))).alias("n_left_duplicates"),
        F.sum(F.greatest(F.col("r") - 1, F.lit(0))).alias("n_right_duplicates"),
    )
    joined = found.join(declared, "pair_id", "left")
    agrees = (F.col("n_left_unique") == F.col("n")) & (F.col("n_right_unique") == F.col("n")) & (F.col("n_overlap") == F.col("intersection_count")) & (F.col("n_left_duplicates") == F.col("duplicate_count")) & (F.col("n_right_duplicates") == F.col("duplicate_count"))
    return joined.withColumn("agrees", F.coalesce(agrees, F.lit(False))).select(*found.columns, "agrees")
