"""Order within one large group, against windows and ``percentile``."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.operators import intervals, ranges, sets
from cellweave.plans import fixtures, runlog

FOLDER = "/root/testdata/sf0.01"


def plain_ranks(rows):
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "w")).cast("long"))


def test_ranks(spark):
    rnd = random.Random(5)
    rows = [(None if g == 1 else g, rnd.choice([None, *range(60)]), k) for g, n in ((1, 400), (2, 30), (3, 700), (4, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, v int, w int").repartition(5)
    want = sorted(map(str, plain_ranks(df).collect()))
    for whole, partitions in ((10_000, None), (100, 7), (100, None), (0, 9)):
        found = ranges.ranked(df, "g", [F.col("v"), F.col("w")], whole=whole, partitions=partitions)
        assert sorted(map(str, found.collect())) == want
    assert ranges.ranked(df.limit(0), "g", [F.col("v")], whole=0).collect() == []


def test_one_set_of_all_items_is_spread_evenly(spark):
    """No partition holds more than twice the median."""
    rows = sets.prepared(fixtures.one_set(spark, FOLDER))
    laid = ranges.laid_out(rows, "set_id", [F.col("grid_code")], 8)
    sizes = sorted(r["count"] for r in laid.groupBy(ranges.PART).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    ranked = sets.prepare_cells(fixtures.one_set(spark, FOLDER), whole=1000)
    assert ranked.agg(F.max("rank"), F.count_distinct("rank")).first()[:] == (rows.count(), rows.count())


def test_islands(spark):
    rnd = random.Random(7)
    nodes = [(i, t := rnd.randint(0, 3000), rnd.choice([0, 0, 1, 2, 9])) for i, n in ((1, 500), (2, 20), (3, 300)) for _ in range(n)]
    nodes += [(3, 5000 + 2 * k, 1) for k in range(200)] + [(4, 0, 13)] + [(4, k, 0) for k in range(100, 400)] + [(None, 7, 1)] * 3 + [(None, k * 8, 2) for k in range(150)]
    df = spark.createDataFrame(nodes, "interval_id int, toff long, lt int").repartition(4)
    want = {}
    for i in {x[0] for x in nodes}:
        out = []
        for a, b in sorted((t, t + (1 << k)) for j, t, k in nodes if j == i):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want[i] = out
    for whole in (10_000, 100, 0):
        found = {}
        for r in intervals.merged_spans(df, whole).collect():
            found.setdefault(r.interval_id, []).append([r.start, r.end])
        assert {i: sorted(x) for i, x in found.items()} == want


def test_quantiles(spark):
    rnd = random.Random(3)
    values = {
        1: [rnd.gauss(0, 1) for _ in range(900)],
        2: [rnd.choice([0.0, -0.0, 1.0, 1e300, -1e308, 1e308, 5e-324]) for _ in range(700)],
        3: [7.5] * 400,
        4: [float(k % 3) for k in range(500)] + [float("nan"), None],
        5: [3.0],
        6: [None],
        7: [1e-9 * k for k in range(300)] + [1e12],
        None: [rnd.random() for _ in range(333)],
    }
    df = spark.createDataFrame([(g, "x", v) for g, vs in values.items() for v in vs], "g int, h string, v double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    kept = df.where("v is not null and not isnan(v)")
    want = {r.g: (r.q, r.n) for r in kept.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"), F.count("*").alias("n")).collect()}
    for whole in (10_000, 350, 20):
        found = {r.g: (r.q, r.n) for r in ranges.quantiles(df, ["g", "h"], "v", shares, whole, [F.count("*").alias("n")]).collect()}
        assert found == want


def test_repeats_of_a_large_case(spark):
    rows = fixtures.run_log(spark, "/root/testdata/sf0.001").withColumn("case", F.when(F.col("pos") % 9 == 0, "small").otherwise("large")).withColumn("comm_send_bytes", F.col("pos") % 50)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(runlog.summarize_repeats(rows, whole=200)) == shown(runlog.summarize_repeats(rows))
    one = rows.withColumn("case", F.lit("all")).withColumn("comm_total_bytes", F.lit(None).cast("long"))
    assert shown(runlog.summarize_repeats(one, whole=5)) == shown(runlog.summarize_repeats(one))


def test_tree_of_hashes(spark):
    rnd = random.Random(2)
    codes = [rnd.getrandbits(64) - (1 << 63) for _ in range(300)] + [rnd.randint(0, 1 << 18) for _ in range(300)] + [-1, 0, -(1 << 63)]
    df = spark.createDataFrame([(1, c) for c in codes], "set_id int, grid_code long")
    found = sets.set_fingerprint_tree(df).first().fingerprint
    assert sets.set_fingerprint_tree(df.union(df).repartition(7, "grid_code")).first().fingerprint == found
    assert sets.set_fingerprint_tree(df.where("grid_code <> 0")).first().fingerprint != found
    assert sets.set_fingerprint_tree(df.limit(0)).collect() == []


@pytest.mark.parametrize("whole", [3, 100])
def test_first_seen(spark, whole):
    rows = [(s, c, p) for p, (s, c) in enumerate([(1, 5), (1, 3), (1, 5), (2, 3), (1, 9), (1, 3), (1, 1), (2, 8)])]
    found = sets.dedup_first_seen(spark.createDataFrame(rows, "set_id int, grid_code long, pos long"), whole=whole)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 6, 4), (1, 3, 1, 2), (1, 5, 0, 1), (1, 9, 4, 3), (2, 3, 3, 1), (2, 8, 7, 2)]
