"""Readers, writers, checks and generators of cell tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.operators.guards import guarded

JSON_SCHEMA = "grid_codes array<string>, codes array<string>, layout map<string,string>, manifest map<string,string>, label string, party_id string"
LAYOUT_KEYS = list(codes.LAYOUT)


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (F.upper(F.trim(text)) == "NULL")


def read_cells_csv(spark: SparkSession, paths, key: str = "grid_code") -> DataFrame:
    """(source, text, grid_code): codes of CSV files with a header, from the key column or else the first one.

    Blank and NULL cells are skipped; decimal and 0x text is read; a text that is no code keeps a null grid_code (see
    ``reject_bad_codes``). A byte order mark and quotes are Spark's reader's matter.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(paths)
    name = next((c for c in raw.columns if c.strip().lstrip("﻿") == key), raw.columns[0])
    text = F.col(f"`{name}`")
    return raw.where(~_blank(text)).select(F.col("_metadata.file_path").alias("source"), F.trim(text).alias("text"), codes.cell_from_text(text).alias("grid_code"))


# A piece of a JSON array between two commas: a string without escapes, a number or another plain value.
_SPACE = r"[\x20\t\r\n]*"
_PLAIN = rf'^{_SPACE}(?:"([^"\\]*)"|(-?[0-9][0-9.eE+-]*|true|false|null)){_SPACE}$'
_PLAIN_NEXT = rf'\G{_SPACE}(?:"[^"\\,]*"|-?[0-9][0-9.eE+-]*|true|false|null){_SPACE}(?:,|\z)'
_NUMBER = r'(?:0[xX][0-9a-fA-F]+|[+-]?[0-9]+)'
_PAIR = rf'^{_SPACE}(\{{?){_SPACE}"{_SPACE}({_NUMBER}){_SPACE}"{_SPACE}:{_SPACE}("?){_SPACE}([+-]?[0-9]+){_SPACE}\3{_SPACE}(\}}?){_SPACE}$'
#: Frames of one row a file are sent to every task up to so many files; beyond, files are many and small.
BROADCAST_FILES = 100_000
#: Codes that a JSON record on a line should hold at most.
RECORD_CODES = 100_000


def _pieces(spark: SparkSession, paths, separator: str) -> DataFrame:
    """(source, at, text): what lies between separators in text files, read in splits, with its place: the split's offset in the
    file and a number that grows within the split. A byte order mark is left out."""
    raw = spark.read.option("lineSep", separator).text(paths)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return raw.select(F.col("_metadata.file_path").alias("source"), at.alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def _bad_files(judged: DataFrame, listed: list[str] = ()) -> DataFrame:
    """One row (bad, what): how many files aren't ok, and the first of them. judged: (source, ok). Of the listed files those that
    aren't judged hold not a byte, which Spark passes over, and aren't ok."""
    every = judged.select("source", F.coalesce("ok", F.lit(False)).alias("ok"))
    if listed:
        short = lambda path: F.regexp_replace(path, "^([a-zA-Z0-9]+):/+", "$1:/")
        names = judged.sparkSession.createDataFrame([(f,) for f in listed], "name string")
        void = names.join(judged, short("name") == short("source"), "left_anti")
        every = every.union(void.select("name", F.lit(False)))
    return every.agg(F.count_if(~F.col("ok")).alias("bad"), F.min(F.when(~F.col("ok"), F.col("source"))).alias("what"))


def read_cells_json(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """(source, label, party_id, layout, text, grid_code): codes of JSON files, each an array or an object with codes.

    The array may be of any size: files are read in splits, cut at commas; only what stands around the array of codes is put
    together again, a row a file. A byte order mark is passed over. A file that is malformed, has anything after its end, no
    array of codes, or an element that isn't a plain value (strings with a comma or an escape are none) fails the job with its
    name, whichever columns are read. Null and blank codes are skipped.

    ``lines``: each line of the files is such an array or object (JSON Lines), so that many sets share a file. A line is held in a
    row; blank lines are skipped, and a file without any holds no set.
    """
    if lines:
        texts = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
        records = _records(texts.where(F.trim(F.col("text"), F.lit(" \t\r\n")) != ""))
        rows = records.where("not none").select(*_known(), F.explode(F.split("elements", ",")).alias("element"))
        return guarded(_codes(rows), _bad_files(records), "no array of codes in ")
    rows, files, listed = _code_files(spark, paths)
    return guarded(rows, _bad_files(files, listed), "no array of codes in ")


def _known(source: str = "source") -> list[Column]:
    return [F.col("source").alias(source), F.col("r.label"), F.col("r.party_id"), F.coalesce("r.layout", "r.manifest").alias("layout")]


def _frame_record() -> tuple[Column, Column]:
    """(the record, whether it is one) of a ``frame``: a JSON text whose array of codes was emptied."""
    record = F.from_json(F.concat(F.lit("["), F.col("frame"), F.lit("]")), f"array<struct<{JSON_SCHEMA.replace(' ', ':').replace(',:', ', ')}>>")
    lone = F.regexp_replace("frame", _SPACE, "") == "[]"
    return F.when(~lone & (F.size(record) == 1), record[0]), lone | (F.coalesce(F.size(record), F.lit(0)) == 1)


def _records(texts: DataFrame) -> DataFrame:
    """(source, r, elements, none, ok) of rows (source, text), each an array or an object with codes."""
    bare = rf"(?s)^({_SPACE}\[)([^\]]*)(\].*)$"
    key = lambda name: rf'(?s)^(.*?(?<!\\)"{name}"{_SPACE}:{_SPACE}\[)([^\]]*)(\].*)$'
    patterns = [(bare, F.lit(True)), *[(key(name), F.contains("text", F.lit(f'"{name}"'))) for name in ("grid_codes", "codes")]]
    cut = lambda k: F.coalesce(*[F.when(likely & F.col("text").rlike(p), F.regexp_extract("text", p, k)) for p, likely in patterns])
    found = texts.select("source", cut(2).alias("elements"), F.concat(cut(1), cut(3)).alias("frame"))
    r, one = _frame_record()
    none = F.trim(F.col("elements"), F.lit(" \t\r\n")) == ""
    # Plain values up to the end, found one after the other; a comma at the end is followed by none.
    plain = none | (F.regexp_replace("elements", _PLAIN_NEXT, "") == "") & ~F.endswith(F.trim(F.col("elements"), F.lit(" \t\r\n")), F.lit(","))
    return found.select("source", r.alias("r"), "elements", none.alias("none"), F.coalesce(plain & one, F.lit(False)).alias("ok"))


def _codes(rows: DataFrame) -> DataFrame:
    """The codes of rows with a plain ``element``; null and blank ones are skipped."""
    value = F.trim(F.col("element"), F.lit(" \t\r\n"))
    text = F.when(F.startswith(value, F.lit('"')), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    found = rows.select("source", "label", "party_id", "layout", text.alias("text")).where(~_blank(F.col("text")))
    return found.select("*", codes.cell_from_text("text").alias("grid_code"))


def _code_files(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, list[str]]:
    """(the codes of all files, (source, ok) of each file that holds a byte, all files listed)."""
    pieces = _pieces(spark, paths, ",")
    listed = pieces.inputFiles()
    few = F.broadcast if len(listed) <= BROADCAST_FILES else (lambda df: df)
    key = lambda name: rf'(?s)^(.*(?<!\\)"{name}"{_SPACE}:{_SPACE}\[)(.*)$'
    bare = rf"(?s)^({_SPACE}\[)(.*)$"
    first_of = lambda pattern: F.min(F.when(F.col("text").rlike(pattern), F.col("at")))
    heads = pieces.groupBy("source").agg(F.min("at").alias("first"), F.min_by("text", "at").alias("head"), first_of(key("grid_codes")).alias("named"), first_of(key("codes")).alias("short"))
    pattern = F.when(F.col("head").rlike(bare), bare).when(F.col("named").isNotNull(), key("grid_codes")).otherwise(key("codes"))
    heads = heads.select("source", F.when(F.col("head").rlike(bare), F.col("first")).otherwise(F.coalesce("named", "short")).alias("open"), pattern.alias("pattern"))
    placed = pieces.join(few(heads), "source")
    cut = lambda k: F.call_function("regexp_extract", F.col("text"), F.col("pattern"), F.lit(k))
    opens = F.col("at") == F.col("open")
    tail = F.when(opens, cut(2)).otherwise(F.col("text"))
    placed = placed.select("source", "at", "text", "open", F.when(opens, cut(1)).alias("before"), tail.alias("tail"))
    ends = placed.where((F.col("at") >= F.col("open")) & F.contains("tail", F.lit("]"))).groupBy("source").agg(F.min("at").alias("close"))
    placed = placed.join(few(ends.withColumnRenamed("source", "own")), F.col("source") == F.col("own"), "left")
    opens, closes = F.col("at") == F.col("open"), F.coalesce(F.col("at") == F.col("close"), F.lit(False))
    inside = (F.col("at") >= F.col("open")) & (F.col("at") <= F.col("close"))
    element = F.when(closes, F.substring_index("tail", "]", 1)).otherwise(F.col("tail"))
    after = F.when(closes, F.substr("tail", F.locate("]", F.col("tail"))))
    placed = placed.select("source", "at", F.coalesce(inside, F.lit(False)).alias("inside"), element.alias("element"), (opens & closes & (F.trim(element, F.lit(" \t\r\n")) == "")).alias("none"), F.when(inside, F.concat(F.coalesce("before", F.lit("")), F.coalesce(after, F.lit("")))).otherwise(F.col("text")).alias("around"), (opens | closes | ~F.coalesce(inside, F.lit(False))).alias("outer"))
    # The file without its elements: what stands before the array, an empty array, and what stands after it.
    frame = F.sort_array(F.collect_list(F.when(F.col("outer"), F.struct("at", "around"))))
    text = F.replace(F.array_join(F.transform(frame, lambda s: s["around"]), ","), F.lit("[,]"), F.lit("[]"))
    files = placed.groupBy("source").agg(text.alias("frame"), F.count_if(F.col("inside")).alias("n"), F.count_if(F.col("inside") & ~F.col("none") & ~F.col("element").rlike(_PLAIN)).alias("wrong"))
    r, one = _frame_record()
    files = files.select("source", r.alias("r"), ((F.col("n") > 0) & (F.col("wrong") == 0) & one).alias("ok"))
    known = files.select(*_known("own"))
    rows = placed.where("inside and not none").select("source", F.regexp_extract("element", _PLAIN, 1).alias("quoted"), F.regexp_extract("element", _PLAIN, 2).alias("plain"))
    rows = rows.select("source", F.when(F.col("plain") != "", F.col("plain")).otherwise(F.col("quoted")).alias("text")).where(~_blank(F.col("text")))
    rows = rows.join(few(known), F.col("source") == F.col("own"))
    rows = rows.select("source", "label", "party_id", "layout", "text", codes.cell_from_text("text").alias("grid_code"))
    return rows, files, listed


def cells_from_rows(spark: SparkSession, inputs: dict[str, list]) -> DataFrame:
    """(set_id, grid_code) of in-memory codes by name; an unsigned number becomes the BIGINT of its bits."""
    rows = [(name, str(code)) for name, values in inputs.items() for code in values]
    return spark.createDataFrame(rows, "set_id string, text string").select("set_id", codes.cell_from_text("text").alias("grid_code"))


def reject_bad_codes(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a reason) by whether the text is a code in [0, 2^64)."""
    number = codes.number_from_text(text)
    reason = F.when(F.lower(F.trim(text)).isin("true", "false"), "boolean").when(number.isNull(), "not a number").when(~codes.cell_is_valid(text), "out of range")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def read_weights(spark: SparkSession, path) -> DataFrame:
    """(grid_code, value) from CSV files of two whole-number columns (a header may be a file's first line) or files that hold one
    JSON object of codes and whole numbers.

    Files are read in splits. Of several values of a code the later one counts: that of the later file by path, and within a file
    of the later line. A line that isn't two whole numbers, a JSON value that isn't one, a malformed file, a code beyond 64 bits and a
    value beyond BIGINT fail the job with the file's name, whichever columns are read. A JSON value may be quoted.
    """
    return guarded(*_weight_files(spark, path), "a line or value isn't a pair of whole numbers in ")


def _weight_files(spark: SparkSession, path, each: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the weights of all files, one row (bad, what) about them, or (source, ok) of ``each``)."""
    paths = [path] if isinstance(path, str) else list(path)
    as_json = {p.lower().endswith(".json") for p in paths}
    if len(as_json) != 1:
        raise ValueError("name CSV files or JSON files, not both")
    if path_is_json(paths):
        parts = _pieces(spark, paths, ",")
        get = lambda k: F.regexp_extract("text", _PAIR, k)
        lone = F.col("text").rlike(rf"^{_SPACE}\{{{_SPACE}\}}{_SPACE}$")
        rows = parts.select("source", "at", lone.alias("lone"), F.when(F.col("text").rlike(_PAIR), F.struct(get(2).alias("code"), get(4).alias("value"))).alias("pair"), (get(1) == "{").alias("opens"), (get(5) == "}").alias("closes"))
        first, last = (f(F.col("opens" if f is F.min_by else "closes"), F.col("at")) for f in (F.min_by, F.max_by))
        whole = first & last & (F.count_if(F.col("opens")) == 1) & (F.count_if(F.col("closes")) == 1) & (F.count_if(F.col("pair").isNull()) == 0)
        judged = whole | ((F.count("*") == 1) & F.bool_and("lone"))
    else:
        parts = _pieces(spark, paths, "\n").withColumn("text", F.trim(F.col("text"), F.lit(" \t\r")))
        cut = F.transform(F.split("text", ","), lambda x: F.trim(x, F.lit(" \t")))
        integer = lambda k: F.coalesce(F.get(cut, F.lit(k)).rlike("^[+-]?[0-9]+$"), F.lit(False))
        pair = F.when((F.size(cut) == 2) & integer(0) & integer(1), F.struct(F.get(cut, F.lit(0)).alias("code"), F.get(cut, F.lit(1)).alias("value")))
        rows = parts.select("source", "at", (F.col("text") == "").alias("blank"), (~integer(0)).alias("header"), pair.alias("pair"))
        wrong = F.col("pair").isNull() & ~F.col("blank")
        judged = F.count_if(wrong) == F.min_by((wrong & F.col("header")).cast("int"), "at")  # none, or a header alone
    rows = rows.withColumn("grid_code", codes.cell_from_text("pair.code")).withColumn("value", F.col("pair.value").try_cast("bigint"))
    beyond = F.col("pair").isNotNull() & (F.col("grid_code").isNull() | F.col("value").isNull())
    files = rows.groupBy("source").agg((judged & (F.count_if(beyond) == 0)).alias("ok"))
    found = rows.where("pair is not null").groupBy("grid_code").agg(F.max_by("value", F.struct("source", "at")).alias("value"))
    # A CSV file without a byte holds no line and is fine.
    return found, files if each else _bad_files(files, parts.inputFiles() if path_is_json(paths) else ())


def path_is_json(paths: list[str]) -> bool:
    return paths[0].lower().endswith(".json")


def layout_mismatches(left: Mapping | None, right: Mapping | None) -> list[str]:
    """The layout keys by which two declared manifests differ; none if either isn't declared. Keys that both lack are passed over."""
    if left is None or right is None:
        return []
    text = lambda m, k: None if m.get(k) is None else str(m[k])
    return [k for k in LAYOUT_KEYS if text(left, k) != text(right, k)]


def layout_agreement(left, right) -> Column:
    """struct(agreement, mismatches) of two manifests (maps): null if either is missing; keys that both lack are passed over."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    keys = F.array(*map(F.lit, LAYOUT_KEYS))
    differ = F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    known = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(known, F.size(differ) == 0).alias("agreement"), F.when(known, differ).otherwise(F.array().cast("array<string>")).alias("mismatches"))


def write_cells(cells: DataFrame, path: str, partitions: int | None = None, format: str = "csv") -> None:
    """Codes in unsigned order, as files whose names follow it: one column grid_code of unsigned numbers."""
    ordered = cells.select("grid_code", *[k.alias(f"k{i}") for i, k in enumerate(codes.unsigned_order("grid_code"))])
    ordered = ordered.repartitionByRange(partitions, "k0", "k1") if partitions else ordered.repartitionByRange("k0", "k1")
    out = ordered.sortWithinPartitions("k0", "k1").select(codes.to_unsigned("grid_code").alias("grid_code"))
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path)


def write_records(records: DataFrame, path: str, format: str = "json", columns: list[str] | None = None) -> None:
    """Run records as JSON lines, or as CSV with a fixed order of columns (maps as JSON text)."""
    out = records.select(*(columns or records.columns))
    if format == "json":
        out.write.mode("overwrite").json(path)
        return
    maps = {c: F.to_json(c) for c, kind in out.dtypes if kind.startswith(("map", "struct", "array"))}
    out.withColumns(maps).write.mode("overwrite").option("header", True).csv(path)


def lineitem_cells(lineitem: DataFrame, quantity: bool = True, id: str = "l_suppkey") -> DataFrame:
    """A driver table as cell sets: part numbers as X, quantities as Z. A projection, so pruning and filters reach the scan."""
    z = F.col("l_quantity").cast("bigint") if quantity else F.lit(0)
    code = codes.encode_cell(F.pmod(F.col("l_partkey"), F.lit(65536)), 0, z, 15 if quantity else 0, 0, 0, strict=False)
    return lineitem.select(F.col(id).alias("set_id"), code.alias("grid_code"))


# --- generators -----------------------------------------------------------------------------------------------------


def _numbered(n: Column, z: int, level: int, toff: int, lt: int, high_bit: bool) -> Column:
    code = codes.encode_cell(n.bitwiseAND(F.lit(131071)), F.shiftright(n, 17).bitwiseAND(F.lit(131071)), z, level, toff, lt)
    return code.bitwiseOR(F.shiftleft(F.lit(1).cast("bigint"), 63)) if high_bit else code


def generate_cell_pairs(spark: SparkSession, n: int, overlap: float = 0.5, duplicates: float = 0.0, high_bit: bool = False, level: int = 9, z: int = 15, toff: int = 0, lt: int = 4) -> DataFrame:
    """(side, pos, grid_code): two sets of n distinct codes with a chosen overlap, then some of the first ones again."""
    if n <= 0 or not 0 <= overlap <= 1 or not 0 <= duplicates < 1:
        raise ValueError("n must be positive, overlap in [0, 1] and duplicates in [0, 1)")
    common, again, extra = round(n * overlap), round(n * duplicates), ((n >> 17) + 1) << 17
    pos = F.col("id")
    base = F.when(pos >= n, pos - n).otherwise(pos)
    rows = spark.range(n + again)
    left = rows.select(F.lit("left").alias("side"), pos.alias("pos"), _numbered(base, z, level, toff, lt, high_bit).alias("grid_code"))
    right = rows.select(F.lit("right").alias("side"), pos.alias("pos"), _numbered(F.when(base < common, base).otherwise(base - common + extra), z, level, toff, lt, high_bit).alias("grid_code"))
    return left.unionAll(right)


def generate_vectors(spark: SparkSession, k: int) -> DataFrame:
    """(i, left, right, value, weight, left_toff, left_lt, right_toff, right_lt) for i < k, in fixed rules."""
    i = F.col("id")
    return spark.range(k).select(i.alias("i"), (i % 32).alias("left"), (i * 3 % 32).alias("right"), (i % 100 + 1).alias("value"), (i % 7 + 1).alias("weight"), (i * 8 % 16000).alias("left_toff"), (i % 3 + 2).cast("int").alias("left_lt"), ((i * 8 + 4) % 16000).alias("right_toff"), (i % 3 + 2).cast("int").alias("right_lt"))


# The sample route, zone and sensitive cells, and the route's weights.
SAMPLE = {
    "route": [3076691977860022276, 3076832715348377604, 3076973452836732932],
    "nofly": [3076832715348377604, 3076973452836732932, 3236851239608385540],
    "sensitive": [3076973452836732932, 3096254488741412868],
}
SAMPLE_WEIGHTS = [(3076691977860022276, 1), (3076832715348377604, 4), (3076973452836732932, 9)]


def sample_cells(spark: SparkSession) -> DataFrame:
    return cells_from_rows(spark, SAMPLE)
