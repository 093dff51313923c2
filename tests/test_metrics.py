"""Near pairs against a plain comparison of all, in many cells, of small and large values and of vectors longer than the fields."""

import random

import pytest

from cellweave.operators import metrics


def plain(rows, threshold):
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and None not in a[2] + b[2]]
    return sorted((a[0], b[0], d) for a, b in pairs if (d := sum((p - q) ** 2 for p, q in zip(a[2], b[2]))) <= threshold**2)


@pytest.mark.parametrize(("least", "span", "length", "threshold"), [(-7, 30, 3, 9), (0, 255, 64, 640), (0, 255, 67, 700), (-(2**40), 400, 70, 800), (5, 5000, 2, 900), (0, 5000, 40, 9000), (2**60, 3, 2, 1)])
def test_near_pairs(spark, least, span, length, threshold):
    rnd = random.Random(span + length)
    ids = rnd.sample(range(-1000, 1000), 90)
    rows = [(k, rnd.choice(["a", "b"]), [least + rnd.choice([0, span, rnd.randint(0, span)]) for _ in range(rnd.choice([length, length, length - 1]))]) for k in ids]
    rows += [(1001, "a", []), (1002, "a", []), (1003, "a", [least, None]), (1004, "a", rows[0][2]), (1005, None, rows[0][2]), (1006, "a", None)]
    df = spark.createDataFrame(rows, "vec_id long, l string, values array<bigint>")
    want = plain([r for r in rows if r[1] and r[2] is not None], threshold)
    assert want
    for cell in (4, metrics.CELL_ROWS):
        found = metrics.pairs_within_distance(df, threshold, group="l", cell=cell)
        assert sorted(map(tuple, found.collect())) == want


def test_popular_bucket_is_many_cells(spark):
    """All vectors in one bucket: the join's keys are those of cells of a few hundred pairs, and its test runs as generated code."""
    df = spark.range(600).selectExpr("id AS vec_id", "array(id % 7, id % 5) AS values")
    found = metrics.pairs_within_distance(df, 1000, cell=16)
    assert found.count() == 600 * 599 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "aggregate(zip" not in plan


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, values array<bigint>")
    assert metrics.pairs_within_distance(df, 3).collect() == []
    assert [tuple(r) for r in metrics.pairs_within_distance(spark.createDataFrame([(1, [4]), (2, [4]), (3, [5])], df.schema), 0).collect()] == [(1, 2, 0)]
