"""Refusals that hold whatever is read of a result: filtered and empty other sides, unread columns, counts and first rows."""

import json

import pytest
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.operators import metrics, sets
from cellweave.operators.guards import guarded
from cellweave.plans import catalogue, runlog
from cellweave.sources import cells as source

CELLS = "set_id int, grid_code long"
USES = {
    "all": lambda df: df.collect(),
    "count": lambda df: df.count(),
    "first": lambda df: df.first(),
    "one column": lambda df: df.select(df.columns[0]).collect(),
    "last column": lambda df: df.select(df.columns[-1]).collect(),
    "filtered": lambda df: df.where(f"`{df.columns[0]}` is not null").collect(),
    "no such row": lambda df: df.where(F.col(df.columns[0]).cast("string") == "-77").collect(),
    "grouped": lambda df: df.groupBy(df.columns[0]).count().collect(),
    "joined": lambda df: df.join(df.select(df.columns[0]).distinct().withColumnRenamed(df.columns[0], "k"), F.col(df.columns[0]) == F.col("k")).collect(),
}


def refuses(frame, match, uses=tuple(USES)):
    for use in uses:
        with pytest.raises(Exception, match=match):
            USES[use](frame())
            pytest.fail(use)


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_weights_are_refused_whatever_the_right_side_is(spark, aqe, tmp_path):
    """A code without a value, and values out of range, also where no right set holds the code."""
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        spark.createDataFrame([(1, 5), (1, 6)], CELLS).write.parquet(str(tmp_path / "left"))
        left = spark.read.parquet(str(tmp_path / "left"))
        right = spark.createDataFrame([(9, 5), (9, 6), (8, 7)], CELLS)
        rights = {"whole": right, "filtered by code": right.where("grid_code = 5"), "filtered by set": right.where("set_id = 8"), "empty": right.where("grid_code > 99"), "known to be empty": right.limit(0)}
        weights = lambda rows: spark.createDataFrame(rows, "grid_code long, value long")
        for k, rows in enumerate(([(5, 1)], [(5, 1), (6, -3)], [(5, 1), (6, None)])):
            for n, other in enumerate(rights.values()):
                if aqe == "false" and n % 3 != k:
                    continue
                # Every kind of use for one of the three, and one for the others.
                uses = ["all"] if k != n % 3 else list(USES) if aqe == "true" else ["count", "last column", "no such row"]
                refuses(lambda: sets.intersection_sum(left, other, weights(rows)), "no valid weight", uses)  # noqa: B023
        good = weights([(5, 1), (6, 4)])
        assert [tuple(r) for r in sets.intersection_sum(left, right, good).collect()] == [(1, 9, 2, 5)]
        assert sets.intersection_sum(left, rights["empty"], good).collect() == []
        assert sets.intersection_sum(left.limit(0), right, weights([])).collect() == []
        assert [tuple(r) for r in sets.intersection_sum(left, right, weights([(5, 1)]), check=False).collect()] == [(1, 9, 1, 1)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_guard_keeps_types_and_rows(spark):
    rows = spark.sql("SELECT id, cast(id as string) s, id > 1 b, date'2020-01-01' d, timestamp'2020-01-01 00:00:00' t, map('k', id) m, array(id) a, struct(id as x) st, cast(id as decimal(20,0)) n, cast('x' as binary) y FROM range(3)")
    same = guarded(rows, spark.sql("SELECT 0L AS bad"), "no")
    assert same.schema.simpleString() == rows.schema.simpleString() and same.collect() == rows.collect()
    refuses(lambda: guarded(rows, spark.range(4).agg(F.count_if(F.col("id") > 2).alias("bad")), "is bad"), "is bad")


def test_layouts_are_compared_before_any_job(spark):
    cells = spark.createDataFrame([(1, 5)], CELLS)
    never = cells.withColumn("grid_code", F.raise_error(F.lit("a job ran")).cast("long"))
    own, other = dict(codes.LAYOUT), {**codes.LAYOUT, "x_bits": "16", "layout_id": "b"}
    weights = spark.createDataFrame([(5, 1)], "grid_code long, value long")
    for run in (lambda **k: sets.intersects(never, never, **k), lambda **k: sets.contains(never, never, **k), lambda **k: sets.intersecting_pairs(never, never, **k), lambda **k: sets.intersection_sum(never, never, weights, **k), lambda **k: sets.chain_intersect(never, never, never, **k)):
        with pytest.raises(ValueError, match="layout_id, x_bits"):
            run(layouts=(own, other))
        with pytest.raises(ValueError, match="layout_id"):
            run(layouts=({"layout_id": "layout-A", "version": 1}, None, {"layout_id": "layout-B", "version": "1"}))
    for layouts in ((), (own, own), (own, None), (None, None), ({"version": 1}, {"version": "1"})):
        assert sets.intersects(cells, cells, layouts=layouts)


PSI = {"protocol": "P", "psi_execute_ms": 1.0, "n_left": 3}


def test_mixed_record_files_are_refused(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    for k, other in enumerate(({"protocol": "P", "psi_ca_execute_ms": 1.0}, {"op": "x", "k": 3}, {"case": "something"})):
        path = file(f"mixed{k}.json", json.dumps([PSI, PSI, other]))
        refuses(lambda: runlog.load_records(spark, path), "holds a record of|no known family")  # noqa: B023
        refuses(lambda: runlog.unify_job(spark, [path])[1], "holds a record of")  # noqa: B023
        refuses(lambda: runlog.unify_job(spark, [path])[0], "holds a record of", ["one column", "last column"])  # noqa: B023
    good = file("good.json", json.dumps([PSI, {"protocol": "Q", "n_left": 4}]))
    assert runlog.load_records(spark, good).count() == 2
    for name, text in (("object.json", "{}"), ("none.json", "[]"), ("odd.json", json.dumps([{"case": "something"}]))):
        with pytest.raises(Exception):  # noqa: B017
            runlog.load_records(spark, file(name, text)).count()
    with pytest.raises(ValueError, match="not MPC"):
        runlog.load_records(spark, good, "MPC")


def test_compare_job(spark, tmp_path):
    rows = [{"op": "a", "k": 4, "protocol": p, "wall_ms": w, "status": s} for p, w, s in (("X", 3.0, "ok"), ("X", 5.0, "ok"), ("Y", 1.0, "ok"), ("Z", None, "error"))] + [{"op": "b", "k": 8, "protocol": "X", "wall_ms": 9.0, "status": "ok"}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    records, counts = runlog.unify_job(spark, [str(tmp_path / "m.json")], csv=str(tmp_path / "out"))
    ranked, left = runlog.compare_job(records, "total_time", "a", 4)
    assert [(r.label, r.value, r.samples) for r in ranked.collect()] == [("Y", 1.0, 1), ("X", 4.0, 2)] and [tuple(r) for r in left.collect()] == [("Z", "status=error")]
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == runlog.COMMON
    with pytest.raises(ValueError, match="narrow"):
        runlog.compare_job(records, "total_time")
    cased = spark.createDataFrame([("F", "a", 1, "p", 2.0, "ok", {"case": "c1"}), ("F", "a", 1, "p", 4.0, "ok", {"case": ""})], "family string, operation string, input_size int, protocol string, total_time double, status string, metadata map<string,string>")
    assert {r.label for r in runlog.compare_each_group(cased)[0].collect()} == {"c1", "p"}
    with pytest.raises(ValueError, match="comparable"):
        runlog.compare_each_group(cased, "encode_time")


@pytest.fixture(params=["33554432", "23"])
def split_size(spark, request):
    """Files in one split, and in many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield int(request.param)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_weights_in_splits(spark, tmp_path, split_size):
    def read(name, text, *more):
        (tmp_path / name).write_text(text)
        return source.read_weights(spark, [str(tmp_path / n) for n in (name, *more)])

    lines = [f"{k % 40},{k}" for k in range(300)]
    want = {(k, 260 + k if k < 40 else 0) for k in range(40)}
    late = {(k % 40): k for k in range(300)}
    for name, text in (("a.csv", "grid_code,value\n" + "\n".join(lines) + "\n\n"), ("b.csv", "﻿" + "\r\n".join(lines)), ("a.json", "{" + ", ".join(f'"{k % 40}": {k}' for k in range(300)) + "}\n"), ("b.json", json.dumps({str(k): str(late[k]) for k in late}, indent=1))):
        found = read(name, text)
        assert {tuple(r) for r in found.collect()} == set(late.items()) and len(want) == found.count()
        if split_size < 100:
            assert spark.read.option("lineSep", ",").text(str(tmp_path / name)).rdd.getNumPartitions() > 20
    assert {tuple(r) for r in read("c.csv", "1,7\n2,8\n", "a.csv").collect()} == {**late, 1: 7, 2: 8}.items()  # the later file by path
    assert read("none.json", " { } ").collect() == [] and read("none.csv", "").collect() == []
    bad = {"x1.csv": "1,5\n2;6\n", "x2.csv": "a,b\nc,d\n", "x3.csv": "1,5\nh,v\n", "x4.csv": "1,99999999999999999999\n", "x5.csv": "-1,5\n", "x6.csv": "1,5,6\n", "x7.csv": "1,x\n2,3\n", "x8.csv": "\nh,v\n1,2\n"}
    bad |= {"x1.json": '{"1": 5', "x2.json": '{"1": 5} x', "x3.json": '{"1": 5.5}', "x4.json": '{"1": true}', "x5.json": '[1, 2]', "x6.json": '{"a": 1}', "x7.json": '{"1": 5}, {"2": 6}', "x8.json": "", "x9.json": '{"1": 5,}', "x10.json": '{"1": null}', "x11.json": '{"1": 99999999999999999999}', "x12.json": '{"18446744073709551616": 1}', "x13.json": '{"1": "5}', "x14.json": '"1": 5}', "x15.json": '{"1": 5, "2": "six"}'}
    for kind in ("csv", "json"):
        few = {name: text for name, text in bad.items() if name.endswith(kind)}
        for name, text in few.items():
            (tmp_path / name).write_text(text)
        files = source._weight_files(spark, [str(tmp_path / n) for n in [*few, f"a.{kind}", f"b.{kind}"]], each=True)[1].collect()
        assert {r.source.rsplit("/", 1)[1] for r in files if r.ok} == {f"a.{kind}", f"b.{kind}"} and len(files) >= len(few) + 1
    for name in ("x8.json", "x3.csv"):
        with pytest.raises(Exception, match=name):
            read(name, bad[name]).count()
    refuses(lambda: read("x2.json", bad["x2.json"]), "x2.json", ["one column", "last column", "no such row"])


def test_cells_in_splits(spark, tmp_path, split_size):
    def read(name, text, encoding="utf-8"):
        (tmp_path / name).write_text(text, encoding=encoding)
        return source.read_cells_json(spark, str(tmp_path / name))

    many = list(range(500))
    bare = read("a.json", "﻿ " + json.dumps(many, indent=1) + "\n")
    assert sorted(r.grid_code for r in bare.collect()) == many and {(r.label, r.layout) for r in bare.collect()} == {(None, None)}
    record = {"label": "a, \"b\" [1, 2] {x}", "layout": {"bits": 64, "layout_id": "l"}, "grid_codes": list(map(str, many)), "party_id": "p", "other": [1, 2, {"codes": [7]}]}
    for k, text in enumerate((json.dumps(record), json.dumps(dict(reversed(record.items())), indent=2))):
        found = read(f"r{k}.json", text).collect()
        assert sorted(r.grid_code for r in found) == many
        assert {(r.label, r.party_id, r.layout["bits"]) for r in found} == {(record["label"], "p", "64")}
    assert [r.grid_code for r in read("s.json", '{"codes": [ "0x0F" ]}').collect()] == [15]
    assert read("e.json", "[ ]").collect() == [] and read("f.json", '{"codes": [\n], "label": "x"}').collect() == []
    assert {(r.text, r.grid_code) for r in read("n.json", '[1, null, "", "oops", true, 2.5]').collect()} == {("1", 1), ("oops", None), ("true", None), ("2.5", None)}
    bad = {"x1.json": '["1","2"] junk', "x2.json": "[1, ", "x3.json": '{"label": "x"}', "x4.json": "nothing", "x5.json": '{"codes": [1, 2]} {"codes": [3]}', "x6.json": '{"codes": [1, 2]}, {"codes": [3]}', "x7.json": "[1, [2]]", "x8.json": "[1 2]", "x9.json": '[1, {"a": 2}]', "x10.json": "[1,, 2]", "x11.json": "", "x12.json": "[1, 2,]", "x13.json": '{"codes": [1, 2], "label": }', "x14.json": '{"codes": [1, 2]', "x15.json": '["a, b"]', "x16.json": "[1]]"}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    files = source._code_files(spark, [str(tmp_path / n) for n in [*bad, "a.json", "r0.json"]])[1].collect()
    assert {r.source.rsplit("/", 1)[1] for r in files if r.ok} == {"a.json", "r0.json"} and len(files) == len(bad) + 1
    with pytest.raises(Exception, match="x11.json"):
        read("x11.json", "").count()
    refuses(lambda: read("x1.json", bad["x1.json"]), "x1.json", ["one column", "last column", "no such row"])


def test_cells_in_lines(spark, tmp_path):
    """Lines are read as files of the same text are."""
    def read(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return source.read_cells_json(spark, str(tmp_path / name), lines=True)

    many = list(range(3000))
    record = {"label": "a, \"b\" [1, 2] {x}", "layout": {"bits": 64, "layout_id": "l"}, "grid_codes": list(map(str, many)), "party_id": "p", "other": [1, 2, {"codes": [7]}]}
    found = read("a.json", "\ufeff" + json.dumps(many) + "\r\n\n \t\n" + json.dumps(record) + "\n" + json.dumps({**record, "label": "z", "party_id": None, "grid_codes": ["0xFF"]}) + "\n").collect()
    rows = {label: sorted(r.grid_code for r in found if r.label == label) for label in (None, record["label"], "z")}
    assert rows == {None: many, record["label"]: many, "z": [255]} and len(found) == 6001
    assert {(r.label, r.party_id, r.layout and r.layout["bits"]) for r in found} == {(None, None, None), (record["label"], "p", "64"), ("z", None, "64")}
    assert {(r.text, r.grid_code) for r in read("n.json", '[1, null, "", "oops", true, 2.5]\n[ ]\n{"codes": [ ], "label": "x"}\n["18446744073709551615", " 7 ", "-1"]').collect()} == {("1", 1), ("oops", None), ("true", None), ("2.5", None), ("18446744073709551615", -1), (" 7 ", 7), ("-1", None)}
    assert read("v.json", "").collect() == [] and read("w.json", "\n \n").collect() == []
    bad = ['["1","2"] junk', "[1, ", '{"label": "x"}', "nothing", '{"codes": [1, 2]} {"codes": [3]}', '{"codes": [1, 2]}, {"codes": [3]}', "[1, [2]]", "[1 2]", '[1, {"a": 2}]', "[1,, 2]", "[1, 2,]", '{"codes": [1, 2], "label": }', '{"codes": [1, 2]', '["a, b"]', "[1]]", "[,1]", '["1""2"]']
    for k, text in enumerate(bad):
        (tmp_path / f"x{k}.json").write_text("[5]\n" + text + "\n[6]\n")
    judged = source._records(spark.read.text([str(tmp_path / f"x{k}.json") for k in range(len(bad))]).selectExpr("value AS source", "value AS text")).collect()
    assert sorted(r.source for r in judged if not r.ok) == sorted(bad) and len(judged) == 3 * len(bad)
    refuses(lambda: source.read_cells_json(spark, str(tmp_path / "x0.json"), lines=True), "x0.json", ["one column", "last column", "no such row"])


def test_sets_share_files(spark, tmp_path, monkeypatch):
    """The registered query writes no file for each set, and a set of many codes as several records."""
    monkeypatch.setattr(catalogue, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(source, "RECORD_CODES", 100)
    rows = catalogue.QUERIES["s2_read_cells_json"](spark, "/root/testdata/sf0.01")
    assert rows.select("label").distinct().count() == 100
    files = list(tmp_path.rglob("*.txt"))
    assert 0 < len(files) < 20 and 400 < sum(len(f.read_text().splitlines()) for f in files) < 1200


def test_wide_vectors(spark):
    big = 1 << 61
    values = spark.createDataFrame([(1, 0, big), (1, 1, -big), (2, 0, -big), (2, 1, big), (3, 0, 5)], "vec_id int, dim int, value long")
    pairs = lambda *p: spark.createDataFrame(p, "left_id int, right_id int")
    assert [tuple(r) for r in metrics.pair_distances_long(pairs((1, 2), (1, 2)), values).collect()] == [(1, 2, 2 * (2 * big) ** 2)]
    refuses(lambda: metrics.pair_distances_long(pairs((1, 2), (1, 3)), values), "dimensions")
    refuses(lambda: metrics.pair_distances_long(pairs((1, 9)), values), "dimensions")
    weights = spark.createDataFrame([(0, 10), (1, 4)], "dim int, weight long")
    found = {r.vec_id: int(r.score) for r in metrics.weighted_sum_long(values, weights, 7, exact=True).collect()}
    assert found == {1: (6 * big) // 7, 2: (-6 * big) // 7, 3: 50 // 7}
    with pytest.raises(Exception):  # noqa: B017
        metrics.weighted_sum_long(values, weights, 7).collect()
