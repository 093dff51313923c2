"""Work on pairs stays in the tasks that make the pairs, however few rows a task may hold."""

import random

import pytest

from cellweave.operators import bits, intervals, sets, tasks
from cellweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
PAIR = {"left_id", "right_id"}


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["t2_overlapping_pairs", "t2_overlapping_pairs_unaligned", "j2_intersecting_pairs", "j6_chain_intersect", "j9_intersection_sum", "l1_release_boolean", "l2_release_count", "l3_release_count_sum", "l4_agreement", "r1_r2_relations"])
def test_no_exchange_of_pairs(apart, name):
    plan = catalogue.QUERIES[name](apart, FOLDER)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split("), ")[0] for line in plan.split("\n") if "hashpartitioning(" in line]
    assert keys and not [k for k in keys if PAIR <= {x.split("#")[0].strip() for x in k.split(",")}]


def test_containment_joins_both_codes_in_place(apart):
    plan = catalogue.QUERIES["j5_containing_pairs"](apart, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" in plan and "ShuffledHashJoin [cell" in plan
    assert not [line for line in plan.split("\n") if "hashpartitioning(cell" in line and "REPARTITION_BY_NUM" not in line]


def _sets(rng, n, codes):
    """Sets with null ids and codes among them, duplicates and a code that nearly all hold."""
    rows = [(rng.choice([*range(n), None]), rng.choice([*range(codes), None])) for _ in range(n * 3)]
    return rows + [(i, 7) for i in range(n - 2)] + rows[:5]


def _by_set(rows):
    found = {}
    for i, c in rows:
        found.setdefault(i, set()).add(c)
    return found


@pytest.mark.parametrize("packed,pairs,rows", [(4096, 10**7, 10**6), (2, 10**7, 3), (2, 5, 3)])
def test_pairs_of_popular_codes_and_large_sets(spark, monkeypatch, packed, pairs, rows):
    monkeypatch.setattr(sets, "PACKED_IDS", packed)
    monkeypatch.setattr(sets, "SET_PAIRS", pairs)
    monkeypatch.setattr(sets, "TASK_ROWS", rows)
    rng = random.Random(packed + rows)
    a, b = _sets(rng, 9, 12), _sets(rng, 14, 12)
    left, right = (spark.createDataFrame(x, "set_id bigint, grid_code bigint") for x in (a, b))
    held, other = _by_set(a), _by_set(b)
    common = {(i, j): len((held[i] & other[j]) - {None}) for i in held for j in other}
    assert {(r.left_id, r.right_id): r.overlap for r in sets.intersecting_pairs(left, right).collect()} == {k: n for k, n in common.items() if n}
    inside = {(i, j) for i in held for j in other if i is not None and j is not None and None not in other[j] and other[j] <= held[i]}
    found = [tuple(r) for r in sets.containing_pairs(left, right).collect()]
    assert len(found) == len(set(found)) and set(found) == inside


@pytest.mark.parametrize("kind,ids", [("bigint", [-3, 0, 65535, 65536, None]), ("bigint", [-(1 << 24), 5, (1 << 24) + 7]), ("bigint", [-(1 << 63), 0, (1 << 63) - 1]), ("int", [-(1 << 31), -1, None, (1 << 31) - 1]), ("string", ["a", "b", None])])
def test_arrays_of_ids_of_any_range(spark, kind, ids):
    left = spark.createDataFrame([(i, c) for i in ids for c in (1, 2, 2)], f"set_id {kind}, grid_code bigint")
    right = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (None, 1)], "set_id bigint, grid_code bigint")
    expected = {(i, j): n for i in ids for j, n in ((7, 2), (8, 1), (None, 1))}
    found = sets.intersecting_pairs(left, right)
    assert found.schema["left_id"].dataType == left.schema["set_id"].dataType
    assert {(r.left_id, r.right_id): r.overlap for r in found.collect()} == expected
    chained = sets.chain_intersect(left, right, left).collect()
    assert {(r.left_id, r.third_id, r.right_id): r.overlap for r in chained} == {(i, k, j): n for (i, j), n in expected.items() for k in ids} and len(chained) == len(ids) * len(expected)


def test_ids_travel_as_few_bytes(apart):
    left = apart.range(3000).selectExpr("id * 5 AS set_id", "id % 3 AS grid_code")
    for f in (sets.intersecting_pairs, lambda a, b: sets.chain_intersect(a, b, a)):
        plan = f(left, left)._jdf.queryExecution().executedPlan().toString()
        assert "(low, " in plan.split("REPARTITION_BY_NUM")[1]


@pytest.mark.parametrize("aligned", [True, False])
def test_overlaps_in_cells(spark, monkeypatch, aligned):
    monkeypatch.setattr(intervals, "TASK_ROWS", 20)
    rng = random.Random(3)
    rows = [(rng.choice([*range(12), None]), (rng.randrange(40) << k if aligned else rng.randrange(-200, 200)), k) for k in (rng.randrange(4) for _ in range(60))]
    nodes = spark.createDataFrame(rows, "interval_id bigint, toff bigint, lt int")
    expected = {(a, b) for a, s, k in rows for b, t, m in rows if s < t + 2**m and t < s + 2**k}
    found = [tuple(r) for r in intervals.overlapping_pairs(nodes, nodes, aligned=aligned).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    found = [tuple(r) for r in intervals.overlapping_pairs(nodes, nodes, aligned=aligned, ordered=True).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in expected if a is not None and b is not None and a < b}


@pytest.mark.parametrize("often,seats", [(0, 9), (10**6, 2), (10**6, 5)])
@pytest.mark.parametrize("aligned", [True, False])
def test_overlaps_by_bits_and_by_pairs(spark, monkeypatch, often, seats, aligned):
    monkeypatch.setattr(intervals, "OFTEN", often)
    monkeypatch.setattr(bits, "SEATS", seats)
    monkeypatch.setattr(intervals, "least_tasks", lambda _: 2)
    rng = random.Random(seats)
    rows = [(rng.choice([*range(20), None]), (rng.randrange(60) << k if aligned else rng.randrange(-200, 200)), k) for k in (rng.randrange(4) for _ in range(90))]
    left, right = (spark.createDataFrame(x, "interval_id bigint, toff bigint, lt int") for x in (rows[:60], rows[30:]))
    meet = lambda a, b: {(i, j) for i, s, k in a for j, t, m in b if s < t + 2**m and t < s + 2**k}
    found = [tuple(r) for r in intervals.overlapping_pairs(left, right, aligned=aligned).collect()]
    assert len(found) == len(set(found)) and set(found) == meet(rows[:60], rows[30:])
    found = [tuple(r) for r in intervals.overlapping_pairs(left, left, aligned=aligned, ordered=True).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in meet(rows[:60], rows[:60]) if a is not None and b is not None and a < b}
    found = [tuple(r) for r in intervals.overlapping_pairs(left, right, aligned=aligned, ordered=True).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in meet(rows[:60], rows[30:]) if a is not None and b is not None and a < b}


@pytest.mark.parametrize("often,seats", [(0, 9), (10**6, 2), (10**6, 5)])
def test_containment_by_bits_and_by_pairs(spark, monkeypatch, often, seats):
    monkeypatch.setattr(sets, "TASK_ROWS", 3)
    monkeypatch.setattr(sets, "HELD_OFTEN", often)
    monkeypatch.setattr(bits, "SEATS", seats)
    rng = random.Random(seats)
    a = [(i, c) for i in [*range(11), None] for c in [*rng.sample(range(9), 7), None]]
    b = [(i, c) for i in [*range(30), None] for c in rng.sample([*range(10), None], 1 + rng.randrange(6))] + [(40, 8), (40, 8)]
    left, right = (spark.createDataFrame(x, "set_id bigint, grid_code bigint") for x in (a, b))
    held, other = _by_set(a), _by_set(b)
    found = [tuple(r) for r in sets.containing_pairs(left, right).collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i in held for j in other if i is not None and j is not None and None not in other[j] and other[j] <= held[i]}


def test_containment_of_popular_codes_shuffles_no_pairs(apart, monkeypatch):
    """Each wanted set passes through rows of bits; candidates are never dealt by pair, nor tables along a cube."""
    monkeypatch.setattr(sets, "TASK_ROWS", 3)
    left = apart.range(60).selectExpr("id % 20 AS set_id", "id % 3 AS grid_code").union(apart.range(40).selectExpr("id % 20 AS set_id", "3 + id % 2 AS grid_code"))
    right = apart.range(90).selectExpr("id % 45 AS set_id", "id % 4 AS grid_code")
    plan = sets.containing_pairs(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "hashpartitioning(cell" not in plan


def test_more_ids_than_a_row_of_words_has_bits(spark, monkeypatch):
    monkeypatch.setattr(bits, "SEATS", 10**6)
    n = 64 * bits.WORDS + 70
    nodes = spark.range(n).selectExpr("id AS interval_id", "0L AS toff", "id % 3 AS lt")
    assert intervals.overlapping_pairs(nodes, nodes, ordered=True).count() == n * (n - 1) // 2


@pytest.mark.parametrize("aligned", [True, False])
def test_ids_that_meet_often_are_copied_to_few_cells(spark, monkeypatch, aligned):
    """However many pairs there are: each side is copied along the square of slabs, not of pairs."""
    monkeypatch.setattr(intervals, "TASK_ROWS", 1)
    nodes = spark.range(400).selectExpr("id AS interval_id", "0L AS toff", "0 AS lt")
    found = intervals.overlapping_pairs(nodes, nodes, aligned=aligned, ordered=True)
    assert found.rdd.getNumPartitions() <= 4 and found.count() == 400 * 399 // 2


def test_generated_pairs_are_dealt_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(tasks, "TASK_ROWS", 100)
    plan = catalogue.QUERIES["d7_recheck_pair_stats"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    n = 26 * spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    dealt = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and f", {-(-n // 100)})" in dealt[0]
    assert "Aggregate" not in plan.split("REPARTITION_BY_NUM")[1].split("Exchange")[0]


def test_more_work_gets_more_tasks(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks.dealt(spark.range(1), 0, "id").rdd.getNumPartitions() == least
    assert tasks.dealt(spark.range(1), 100 * tasks.TASK_ROWS, "id").rdd.getNumPartitions() == 100
