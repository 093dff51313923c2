"""Golden values, laws and edges of the grid-cell operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellweave import api
from cellweave.functions import codes
from cellweave.operators import bands, intervals, metrics, relations, release, sets
from cellweave.plans import catalogue, runlog
from cellweave.sources import cells as source

FOLDER = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_golden_codes(spark):
    r = one(spark, codes.cell_to_hex(codes.encode_cell(21861, 27702, 15, 9, 2160, 4)), codes.cell_to_hex(codes.encode_cell(21861, 27702, 15, 9, 2040, 4)))
    assert (r.c0, r.c1) == ("0x2AB29B0D87A48704", "0x2AB29B0D87A47F84")
    top = codes.encode_cell(131071, 131071, 127, 31, 16383, 15)
    r = one(spark, codes.to_unsigned(top), codes.from_unsigned(codes.to_unsigned(top)), top, codes.decode_cell(top))
    assert int(r.c0) == 2**64 - 1 and r.c1 == r.c2 == -1 and tuple(r.c3) == (131071, 131071, 127, 31, 16383, 15)
    with pytest.raises(Exception, match="out of range"):
        one(spark, codes.encode_cell(131072, 0, 0, 0, 0, 0))
    assert one(spark, codes.encode_cell(0, 0, 128, 0, 0, 0, strict=False)).c0 is None


def test_text_codes(spark):
    rows = [("0xFFFFFFFFFFFFFFFF", -1, True), ("18446744073709551615", -1, True), ("18446744073709551616", None, False), (" 12 ", 12, True), ("-1", None, False), ("x", None, False), ("", None, False), (None, None, False), ("0x", None, False), ("true", None, False)]
    found = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, text string").select("k", codes.cell_from_text("text").alias("c"), codes.cell_is_valid("text").alias("v")).orderBy("k").collect()
    assert [(r.c, r.v) for r in found] == [r[1:] for r in rows]


def test_heights(spark):
    df = spark.createDataFrame([(21861, 27702, 0.0, 20000.0, 15, 0, 0), (21861, 27702, 9000.0, 5000.0, 15, 0, 0)], "x int, y int, height_min double, height_max double, level int, toff int, lt int")
    layers = {}
    for r in bands.height_layers(df).collect():
        layers.setdefault(r.height_min, []).append(r.layer)
    assert layers == {0.0: list(range(11)), 9000.0: [2, 3, 4]}
    a, b = bands.height_band(df.limit(1)), bands.height_band(df.where("height_min > 0"))
    assert b.join(a, "grid_code", "left_semi").count() == 3
    r = one(spark, *[codes.height_layer_count(F.lit(0.0), F.lit(1000.0), F.lit(n)) for n in (17, 18, 19, 21)], *[codes.height_layer_bits(F.lit(n), F.lit(1000.0)) for n in range(17, 24)])
    assert list(r) == [3, 5, 9, 33, 2, 3, 4, 5, 6, 7, 8]
    assert one(spark, codes.cells_per_deg(F.lit(16))).c0 == 112.5
    with pytest.raises(Exception, match="earth"):
        one(spark, codes.height_index(F.lit(-6378137.0), F.lit(3)))


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(i).cast("bigint") for i in x])
    r = one(spark, codes.distance_le(v(1, 2, 3), v(1, 3, 3), 2), codes.weighted_sum(v(10, 20, 30), v(1, 2, 1)), codes.weighted_sum(v(-7), v(1), 2), codes.distance_le(v(1), v(3), -2))
    assert list(r) == [True, 80, -4, True]
    with pytest.raises(Exception, match="length"):
        one(spark, codes.l2_squared(v(1), v(1, 2)))
    with pytest.raises(Exception, match="scale"):
        one(spark, codes.distance_le(v(1), v(1), 1, F.lit(1), F.lit(2)))
    rnd = random.Random(4)
    rows = [(k, [rnd.randint(0, 40) for _ in range(3)]) for k in range(80)]
    found = {(r.left_id, r.right_id, r.l2) for r in metrics.pairs_within_distance(spark.createDataFrame(rows, "vec_id long, values array<bigint>"), 9).collect()}
    want = {(a, b, d) for a, x in rows for b, y in rows if a < b and (d := sum((p - q) ** 2 for p, q in zip(x, y))) <= 81}
    assert found == want


def greedy(start, end, top=14):
    out = []
    while start < end:
        k = 0
        while k < top and start % (2 << k) == 0 and start + (2 << k) <= end:
            k += 1
        out.append((start, k))
        start += 1 << k
    return out


def test_intervals(spark):
    nodes = spark.createDataFrame([("l", 0, 3), ("l", 4, 2), ("r", 4, 3), ("far", 12, 1)], "interval_id string, toff long, lt int")
    pick = lambda x: nodes.where(F.col("interval_id") == x)
    assert intervals.temporal_overlap(pick("l"), pick("r")) and not intervals.temporal_overlap(pick("l"), pick("far"))
    rnd = random.Random(1)
    windows = [(k, a := rnd.randint(0, 40000), a + rnd.choice([0, 1, 2, 7, 500, 20000])) for k in range(150)]
    df = spark.createDataFrame(windows, "interval_id long, start long, end long")
    found = {}
    for r in intervals.window_to_nodes(df).collect():
        found.setdefault(r.interval_id, []).append((r.toff, r.lt))
    assert all(sorted(found.get(k, [])) == sorted(greedy(a, b)) for k, a, b in windows)
    once = intervals.normalize_intervals(intervals.window_to_nodes(df))
    assert release.bodies_agree(intervals.normalize_intervals(once), once)


def test_sets(spark):
    c = source.sample_cells(spark)
    name = lambda x: c.where(F.col("set_id") == x)
    both = sets.cellset_intersect(name("route"), name("nofly"))
    assert both.count() == 2 and sets.intersects(both, name("sensitive")) and not sets.contains(name("nofly"), name("route"))
    empty = c.limit(0)
    assert sets.contains(empty, empty) and sets.contains(c, empty) and not sets.intersects(c, empty)
    ids = spark.createDataFrame([("route",), ("none",)], "set_id string")
    assert {(r.outer_id, r.inner_id) for r in sets.containing_pairs(c, name("route"), inner_ids=ids).collect()} == {("route", "route"), ("route", "none"), ("nofly", "none"), ("sensitive", "none")}
    weights = spark.createDataFrame(source.SAMPLE_WEIGHTS, "grid_code long, value long")
    assert tuple(sets.intersection_sum(name("route"), name("nofly"), weights).first())[2:] == (2, 13)
    with pytest.raises(Exception, match="weight"):
        sets.intersection_sum(name("nofly"), name("route"), weights).collect()
    counted = sets.prepare_cells(c.union(c.limit(1))).where("set_id = 'route'").orderBy("rank").collect()
    assert [(r.grid_code, r.rank, r.input_count, r.unique_count, r.duplicate_count) for r in counted] == [(x, k + 1, 4, 3, 1) for k, x in enumerate(sorted(source.SAMPLE["route"]))]
    high = spark.createDataFrame([(1, x) for x in (-1, 0, 5, -(2**63), 255)], "set_id int, grid_code long")
    assert [r.grid_code for r in sets.sort_cells(high).collect()] == [0, 5, 255, -(2**63), -1]
    assert release.bodies_agree(sets.expand_prefix_groups(sets.prefix_groups(high)), high)
    assert sets.set_fingerprint(spark.createDataFrame([(1, 1)], "set_id int, grid_code long")).first().fingerprint == "cd2662154e6d76b2"
    assert [r.n for r in sets.prefix_buckets(high, 4).orderBy("bucket").collect()] == [3, 0, 1, 1]
    bodies = sets.intersect_bodies(high, high).first()
    assert list(bodies.codes) == [0, 5, 255, -(2**63), -1]
    for a, b in (("route", "nofly"), ("nofly", "sensitive")):
        assert sets.intersects(name(a), name(b)) == sets.intersects(name(b), name(a))


def test_generated_pairs(spark):
    for n, overlap, dup, high in ((1000, 0.5, 0.25, False), (7, 0.5, 0.0, True), (200000, 0.25, 0.0, False)):
        rows = source.generate_cell_pairs(spark, n, overlap, dup, high).withColumn("pair_id", F.lit(1))
        declared = spark.createDataFrame([(1, n, round(n * overlap), round(n * dup))], "pair_id int, n long, intersection_count long, duplicate_count long")
        assert sets.recheck_pair_stats(rows, declared).first().agrees


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿label,grid_code\nx,12\ny,0xFFFFFFFFFFFFFFFF\nz, \nw,NULL\nv,oops\n", encoding="utf-8")
    rows = source.read_cells_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.text, r.grid_code) for r in rows.collect()) == [("0xFFFFFFFFFFFFFFFF", -1), ("12", 12), ("oops", None)]
    good, bad = source.reject_bad_codes(rows)
    assert good.count() == 2 and [r.reason for r in bad.collect()] == ["not a number"]
    (tmp_path / "b.json").write_text(json.dumps({"codes": ["3", 4], "label": "zone", "party_id": "p", "manifest": {"bits": "64"}}))
    (tmp_path / "c.json").write_text("[5,\n \"0x6\"]")
    found = source.read_cells_json(spark, [str(tmp_path / "b.json"), str(tmp_path / "c.json")]).collect()
    assert sorted((r.grid_code, r.label) for r in found) == [(3, "zone"), (4, "zone"), (5, None), (6, None)]
    (tmp_path / "w.csv").write_text("grid_code,value\n1,5\n2,6\n1,7\n")
    (tmp_path / "w.json").write_text('{"1": 5, "2": 6}')
    assert sorted(map(tuple, source.read_weights(spark, str(tmp_path / "w.csv")).collect())) == [(1, 7), (2, 6)]
    assert sorted(map(tuple, source.read_weights(spark, str(tmp_path / "w.json")).collect())) == [(1, 5), (2, 6)]
    (tmp_path / "bad.csv").write_text("1,5\n2;6\n")
    with pytest.raises(Exception, match="pair of whole numbers"):
        source.read_weights(spark, str(tmp_path / "bad.csv")).collect()
    cells = spark.createDataFrame([(-1,), (3,), (-(2**63),)], "grid_code long")
    source.write_cells(cells, str(tmp_path / "out"), 1)
    back = source.read_cells_csv(spark, str(tmp_path / "out"))
    assert [r.text for r in back.collect()] == ["3", str(2**63), str(2**64 - 1)]


def test_bad_files_fail(spark, tmp_path):
    (tmp_path / "bom.json").write_text("\ufeff[7]", encoding="utf-8")
    assert [r.grid_code for r in source.read_cells_json(spark, str(tmp_path / "bom.json")).collect()] == [7]
    for name, text in (("broken.json", "[1, "), ("none.json", '{"label": "x"}'), ("empty.json", "nothing")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=name):
            source.read_cells_json(spark, str(tmp_path / name)).collect()
    (tmp_path / "mixed.json").write_text(json.dumps([{"protocol": "P", "psi_execute_ms": 1.0, "n_left": 3}, {"protocol": "P", "psi_ca_execute_ms": 1.0}]))
    with pytest.raises(Exception, match="holds a record of"):
        runlog.load_records(spark, str(tmp_path / "mixed.json")).collect()
    with pytest.raises(ValueError, match="comparable"):
        runlog.compare_groups(spark.range(1), "encode_time")


def test_levels_out_of_range(spark):
    for f in (codes.cell_deg, codes.cells_per_deg, codes.equator_scale, codes.height_cell, codes.max_supported_height, lambda n: codes.height_index(F.lit(1.0), n)):
        for bad in (-1, 33, 40):
            with pytest.raises(Exception, match="level"):
                one(spark, f(F.lit(bad)))
        assert one(spark, f(F.lit(32))).c0 is not None


def test_agreement_in_the_policys_shape(spark):
    cells = spark.createDataFrame([(1, 2, 5), (1, 2, 6), (3, 4, 5)], "left_id int, right_id int, grid_code long")
    counts = release.release("CellSetIntersect", cells, "count")
    other = cells.union(cells.limit(1)).where("left_id = 1")
    found = {(r.left_id, r.agrees) for r in release.agreement_under("CellSetIntersect", "count", counts, other).collect()}
    assert found == {(1, True), (3, None)}
    yes = spark.createDataFrame([(1, 2, True)], "left_id int, right_id int, boolean boolean")
    assert {r.agrees for r in release.agreement_under("CellSetIntersect", "count", counts, yes).collect()} == {None}
    assert {r.agrees for r in release.agreement_under("CellSetIntersect", None, cells, cells).collect()} == {True}
    assert {r.agrees for r in release.agreement_under("Intersects", None, yes, yes.withColumn("boolean", F.lit(False))).collect()} == {False}


def test_relations_and_release(spark):
    names = lambda *x: relations.split_subject_object(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))
    r = one(spark, names("no_fly_a", "route_b"), names("a", "b"), names("a"), names(), relations.spatial_scope(F.array(F.lit("x"), F.lit("route_A"))), relations.max_sensitivity(F.array(F.lit("public"), F.lit("odd"))), relations.max_sensitivity(F.array().cast("array<string>")))
    assert [tuple(x) if not isinstance(x, str) else x for x in r] == [("route_b", "no_fly_a"), ("a", "b"), ("a", "<literal>"), ("<none>", "<none>"), "A", "secret", "internal"]
    for op, policy in (("Intersects", "count"), ("WeightedSum", "report"), ("Nothing", None)):
        with pytest.raises(ValueError):
            release.resolve_policy(op, policy)
    assert api.score is codes.weighted_sum and api.altitude_band is bands.height_band
    many = spark.createDataFrame([(k, f"n{k}", f"p{k}") for k in range(3)], "position int, input_name string, party_id string")
    with pytest.raises(Exception, match="parties"):
        relations.party_binding(many).collect()


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text("case,protocol,n_left,n_right,psi_ca_execute_ms,total_ms,status,intersection_count\na,P,4,4,1.5,2.5,ok,2\nb,P,4,4,,,error,\n")
    out, counts = runlog.unify_job(spark, [str(tmp_path / "r.csv")], str(tmp_path / "o"))
    r = out.where("status = 'ok'").first()
    assert (r.family, r.input_size, r.result_size, r.total_time, r.metadata["case"]) == ("PSI-CA", 8, 2, 2.5, "a")
    assert [(x.status, x.n) for x in counts.collect()] == [("ok", 1), ("error", 1)] and spark.read.json(str(tmp_path / "o")).count() == 2
    rows, skipped = runlog.compare_groups(out)
    assert rows.first().samples == 1 and skipped.count() == 1
    with pytest.raises(ValueError):
        runlog.infer_family(spark.range(1))


def test_sql_functions(spark):
    codes.register_sql(spark)
    r = spark.sql("SELECT cell_hex(cell_encode(21861, 27702, 15, 9, 2160, 4)) AS h, cell_decode(cell_encode(1, 2, 3, 4, 5, 6)).toff AS t, node_is_aligned(4, 3) AS a").first()
    assert tuple(r) == ("0x2AB29B0D87A48704", 5, False)


def test_sql_functions_agree_with_the_columns(spark):
    codes.register_sql(spark)
    rows = spark.range(34).selectExpr("id", "cast(least(id, 32) as int) as level", "id * 731.25D - 900D as h", "id % 128 as layer", "shiftleft(id * 7919L, 40) - id as c", "concat(if(id % 3 = 0, '0x', ' '), id, if(id % 5 = 0, 'g', '')) as t", "timestamp'2024-01-01 00:00:30' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts")
    rows.createOrReplaceTempView("scalars")
    origin = "2024-01-01 00:00:00+00:00"
    pairs = {
        "cell_unsigned(c)": codes.to_unsigned("c"), "cell_hex(c)": codes.cell_to_hex("c"), "cell_decode(c)": codes.decode_cell("c"), "cell_from_text(t)": codes.cell_from_text("t"), "cell_is_valid(t)": codes.cell_is_valid("t"),
        "quantize(h, -900D, 30000D, 8)": codes.quantize("h", -900.0, 30000.0), "cell_deg(level)": codes.cell_deg("level"), "cells_per_deg(level)": codes.cells_per_deg("level"), "equator_scale(level)": codes.equator_scale("level"),
        "height_cell(level)": codes.height_cell("level"), "height_layer_lower(layer, level)": codes.height_layer_lower("layer", "level"), "height_layer_bounds(layer, level)": codes.height_layer_bounds("layer", "level"), "height_index(h, level)": codes.height_index("h", "level"),
        "height_layer_count(h, 50D, level)": codes.height_layer_count("h", F.lit(50.0), "level"), "height_layer_bits(level, h)": codes.height_layer_bits("level", "h"), "height_layer_fits(level, h)": codes.height_layer_fits("level", "h"), "height_layer_valid(layer - 3)": codes.height_layer_valid(F.col("layer") - 3),
        "max_supported_height(level)": codes.max_supported_height("level"), "cell_height_interval(cell_encode(1L, 2L, layer, cast(level as bigint) % 32, 0L, 0L))": codes.cell_height_interval(codes.encode_cell(1, 2, "layer", F.col("level") % 32, 0, 0)), "toff_lenient(ts, timestamp'2024-01-01 00:00:00')": codes.toff_lenient("ts", origin),
        "node_span(id, 3)": codes.node_span("id", F.lit(3)), "encode_cell_at_height(3L, 4L, 5, abs(h))": codes.encode_cell_at_height(3, 4, F.lit(5), F.abs("h")),
    }
    sql = spark.sql(f"SELECT {', '.join(f'{x} AS f{k}' for k, x in enumerate(pairs))} FROM scalars ORDER BY id").collect()
    columns = rows.orderBy("id").select(*[c.alias(f"f{k}") for k, c in enumerate(pairs.values())]).collect()
    for k, name in enumerate(pairs):
        assert [str(r[k]) for r in sql] == [str(r[k]) for r in columns], name
    for bad in ("cell_deg(33)", "cell_encode(1L, 2L, 128L, 1L, 0L, 0L)", "quantize(2D, 0D, 1D, 8)", "toff_strict(timestamp'2023-01-01', timestamp'2024-01-01')"):
        with pytest.raises(Exception, match="range|before"):
            spark.sql(f"SELECT {bad} FROM scalars").collect()


def test_streams(spark, tmp_path):
    from cellweave.streaming import cells as streaming

    rows = spark.sql("SELECT 1 AS set_id, 21861 AS x, 27702 AS y, 0.0D AS height_min, 20000.0D AS height_max, 15 AS level, 0 AS toff, 0 AS lt, explode(array(timestamp'2024-01-01 00:01:00', timestamp'2024-01-01 00:02:00', timestamp'2024-01-01 00:06:00')) AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    zones = bands.height_band(rows.limit(1).withColumn("height_min", F.lit(5000.0)).withColumn("height_max", F.lit(9000.0))).select("set_id", "grid_code")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("hits", streaming.zone_hits(streaming.band_cells(stream), zones), "append"), ("windows", streaming.windowed_overlap(streaming.band_cells(stream), zones), "update")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    # Cells that come twice in a window count once there, and anew in the next window.
    assert spark.table("hits").count() == 9
    assert sorted((r.window.start.minute, r.overlap) for r in spark.table("windows").collect()) == [(0, 3), (5, 3)]


def test_plans(spark):
    for name, f in catalogue.QUERIES.items():
        plan = f(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name
    scan = catalogue.QUERIES["s4_cells_table_scan"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in scan
    one = source.lineitem_cells(spark.read.parquet(f"{FOLDER}/lineitem.parquet")).where("set_id < 50")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), LessThan(l_suppkey,50)]" in one


def test_whole_tables(spark):
    """Nothing is left out by id, case or size."""
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, FOLDER)
    assert run("s4_cells_table_scan").agg(F.sum("n")).first()[0] == items.count()
    assert run("j3_cellset_intersect").where("left_id % 2 = right_id % 2").count() > 0
    sizes = run("j7_cardinality").where("not is_empty")
    assert {r.set_id for r in sizes.collect()} == {r.l_suppkey for r in items.select("l_suppkey").distinct().collect()}
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    groups = run("b4_compare_groups")
    assert groups.select("operation", "input_size").distinct().count() == events.selectExpr("event_type", "event_id % 4").distinct().count()
    assert groups.agg(F.sum("samples")).first()[0] == events.where("event_id % 17 <> 0 and event_id % 23 <> 0 and value is not null").count()
    pairs = run("j5_containing_pairs")
    assert pairs.count() == sets.intersecting_pairs(*[source.lineitem_cells(items, False, c) for c in ("l_suppkey", "l_orderkey")]).join(sets.cardinality(source.lineitem_cells(items, False, "l_orderkey")).withColumnRenamed("set_id", "right_id"), "right_id").where("overlap = n_codes").count()
    assert {r.third_id for r in run("j6_chain_intersect").select("third_id").distinct().collect()} == {r.l_linenumber for r in items.select("l_linenumber").distinct().collect()}


def test_compare_each_group(spark):
    rows = [("F", "a", 1, "p", 2.0, "ok"), ("F", "a", 1, "p", 4.0, "ok"), ("F", "b", 2, "p", 5.0, "ok"), ("F", "b", 2, "q", None, "ok"), (None, "b", 2, "q", 1.0, "error")]
    kept, left = runlog.compare_each_group(spark.createDataFrame(rows, "family string, operation string, input_size int, protocol string, total_time double, status string"))
    assert sorted(map(tuple, kept.collect())) == [("F", "a", 1, "p", 3.0, 2, 2.0), ("F", "b", 2, "p", 5.0, 1, None)]
    assert {r.reason for r in left.collect()} == {"no total_time", "status=error"} and left.count() == 2
