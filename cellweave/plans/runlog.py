"""Analytics over run records: common columns, counts, comparisons, statistics and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.guards import guarded
from cellweave.operators.ranges import WHOLE, quantiles, split_by_size

# The common columns, the four families and the columns that they come from.
COMMON = ["family", "protocol", "operation", "world_size", "field", "input_size", "unique_size", "result_size", "compute_time", "communication_bytes", "total_time", "memory_bytes", "status"]
FAMILIES = ["PSI", "PSI-CA", "PI-SUM", "MPC"]
SET_OPERATION = "CellSetIntersect"
COMPARABLE = ["compute_time", "total_time", "communication_bytes", "memory_bytes", "input_size", "result_size"]
WARN_RATIO = 1.5
# Metrics that a family's records never hold, and the raw columns that would hold them.
MISSING_METRICS = {
    "PSI": ["encode_time", "dedup_time", "layout_agreement", "send_bytes", "recv_bytes", "total_bytes"],
    "PSI-CA": ["encode_time", "dedup_time", "input_io_time", "semantic_processing_time", "layout_agreement"],
    "PI-SUM": ["encode_time", "dedup_time", "semantic_processing_time", "layout_agreement"],
    "MPC": ["encode_time", "dedup_time", "input_io_time", "semantic_processing_time"],
}
METRIC_COLUMNS = {
    "encode_time": ["encode_ms", "encode_time"],
    "dedup_time": ["dedup_ms", "dedup_time"],
    "input_io_time": ["input_io_ms", "io_write_ms", "io_read_ms"],
    "semantic_processing_time": ["semantic_ms", "semantic_processing_ms"],
    "layout_agreement": ["layout_agreement"],
    "send_bytes": ["send_bytes", "comm_send_bytes"],
    "recv_bytes": ["recv_bytes", "comm_recv_bytes"],
    "total_bytes": ["total_bytes", "comm_total_bytes"],
}

# The parties that a protocol needs, and the protocols that need a curve.
PARTIES = {
    "PSI": {"PROTOCOL_ECDH": 2, "PROTOCOL_KKRT": 2, "PROTOCOL_RR22": 2, "PROTOCOL_ECDH_3PC": 3, "PROTOCOL_ECDH_NPC": 2, "PROTOCOL_KKRT_NPC": 2, "PROTOCOL_DP": 2},
    "MPC": {"REF2K": 2, "SEMI2K": 2, "ABY3": 3, "CHEETAH": 2, "SECURENN": 3},
}
CURVED = ["PROTOCOL_ECDH", "PROTOCOL_ECDH_3PC", "PROTOCOL_ECDH_NPC"]


def _full_name(protocol: Column, family: str) -> Column:
    """A protocol's official name, however it is written."""
    name = F.upper(F.trim(protocol))
    return F.when(name.startswith("PROTOCOL_") | F.lit(family != "PSI"), name).otherwise(F.concat(F.lit("PROTOCOL_"), name))


def parties(protocol: Column, family: str) -> Column:
    """How many parties a protocol of the family needs; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in PARTIES[family].items() for x in pair])
    return F.try_element_at(known, _full_name(protocol, family))


def _get(raw: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)


def infer_family(raw: DataFrame) -> str:
    """The family that a record table's columns show; unknown columns raise."""
    c = set(raw.columns)
    for family, shown in (("PSI-CA", "psi_ca_execute_ms" in c), ("PI-SUM", "pi_sum_execute_ms" in c), ("MPC", {"op", "k"} <= c), ("PSI", "psi_execute_ms" in c or "n_left" in c)):
        if shown:
            return family
    raise ValueError(f"no known family has these columns: {sorted(c)}")


def unify(raw: DataFrame, family: str | None = None, world_size: int | None = None) -> DataFrame:
    """A family's records in the common columns; what isn't there stays null, and the raw columns go into metadata.

    The world's size is what the protocol needs, or the record's own in the two families whose protocols aren't listed;
    ``world_size`` stands in where neither is known.
    """
    family = family or infer_family(raw)
    get = lambda name, kind="double": _get(raw, name, kind)
    mpc = family == "MPC"
    time = {"PSI": get("psi_execute_ms"), "PSI-CA": get("psi_ca_execute_ms"), "PI-SUM": get("pi_sum_execute_ms"), "MPC": get("wall_ms") - F.coalesce(get("setup_ms"), F.lit(0.0))}[family]
    # An elliptic curve matters to some protocols of the first family only.
    field = get("field", "string") if mpc else F.when(_full_name(get("protocol", "string"), family).isin(CURVED), get("curve", "string")) if family == "PSI" else F.lit(None).cast("string")
    world = parties(get("protocol", "string"), family) if family in PARTIES else get("world_size", "int")
    out = raw.select(
        F.lit(family).alias("family"),
        F.coalesce(get("protocol", "string"), F.lit("")).alias("protocol"),
        (get("op", "string") if mpc else F.coalesce(get("operation", "string"), F.lit(SET_OPERATION))).alias("operation"),
        (F.coalesce(world, F.lit(world_size).cast("int")) if world_size else world).alias("world_size"),
        field.alias("field"),
        (get("k", "bigint") if mpc else get("n_left", "bigint") + get("n_right", "bigint")).alias("input_size"),
        (F.lit(None).cast("bigint") if mpc else get("n_left_unique", "bigint") + get("n_right_unique", "bigint")).alias("unique_size"),
        (F.lit(None).cast("bigint") if mpc else get("intersection_count", "bigint")).alias("result_size"),
        time.alias("compute_time"),
        get("comm_total_bytes" if family in ("PSI", "MPC") else "total_bytes").alias("communication_bytes"),
        get("wall_ms" if mpc else "total_ms").alias("total_time"),
        (get("peak_rss_mb") * 1048576).cast("bigint").alias("memory_bytes"),
        F.coalesce(get("status", "string"), F.lit("unknown")).alias("status"),
        F.map_filter(F.create_map(*[x for c in raw.columns for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()).alias("metadata"),
    )
    return out


def unify_records(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(unify, tables))


def record_family(raw: DataFrame) -> Column:
    """The family that a record's own filled columns show; null for none."""
    filled = lambda c: F.col(c).isNotNull() if c in raw.columns else F.lit(False)
    return F.when(filled("psi_ca_execute_ms"), "PSI-CA").when(filled("pi_sum_execute_ms"), "PI-SUM").when(filled("op") & filled("k"), "MPC").when(filled("psi_execute_ms"), "PSI")


def load_records(spark, path: str, family: str | None = None, file: str | None = None) -> DataFrame:
    """A CSV or JSON file of records in the common columns; the family is inferred from the file's columns. ``file`` names a
    column for its path.

    A record whose own columns show another family, or none, fails the job whichever columns are read: a file holds one
    family. A file without a record fails too, as does JSON that isn't a list of records.
    """
    csv = path.lower().endswith(".csv")
    raw = spark.read.option("header", True).csv(path) if csv else spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = infer_family(raw)
    if family and found != family:
        raise ValueError(f"{path} holds {found} records, not {family}")
    own = record_family(raw)
    # A CSV's columns are all records' columns, also where they are empty; a JSON record's are those that it fills. Sizes
    # alone, as of a run that failed, fit any family of set protocols.
    sized = F.col("n_left").isNotNull() if "n_left" in raw.columns and found != "MPC" else F.lit(False)
    other = F.coalesce(own != found, F.lit(not csv) & ~sized)
    check = raw.agg(F.count_if(other).alias("n"), F.count("*").alias("records"), F.min(F.when(other, F.coalesce(own, F.lit("no known family")))).alias("what"))
    check = check.select((F.col("n") + F.when(F.col("records") == 0, 1).otherwise(0)).alias("bad"), F.coalesce("what", F.lit("no family at all")).alias("what"))
    records = unify(raw, found)
    return guarded(records.withColumn(file, F.lit(path)) if file else records, check, f"{path}: a {found} file holds a record of ")


def status_counts(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(status, n, place): ok first, then unavailable, error, and the rest by name."""
    keys = [*(by or []), "status"]
    n = records.groupBy(*keys).agg(F.count("*").alias("n"))
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "unavailable", 1).when(F.col("status") == "error", 2).otherwise(3)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(rank, "status")
    return n.withColumn("place", F.row_number().over(w)).orderBy(*(by or []), "place")


def _label(records: DataFrame, label: str) -> Column:
    """A record's case, if its metadata name one; else the label's column."""
    return F.coalesce(F.nullif(F.element_at("metadata", F.lit("case")), F.lit("")), F.col(label)) if "metadata" in records.columns else F.col(label)


def compare_groups(records: DataFrame, metric: str = "total_time", label: str = "protocol") -> tuple[DataFrame, DataFrame]:
    """((label, value, samples, spread) by ascending median of the ok rows; (label, reason) of the rows left out).

    Records of several families, operations or sizes aren't comparable and raise, as does a metric that isn't comparable. The
    label of a record that names its case is the case.
    """
    if metric not in COMPARABLE:
        raise ValueError(f"{metric} isn't comparable: {COMPARABLE}")
    records = records.withColumn("label", _label(records, label))
    kinds = records.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("")))for c in ("family", "operation", "input_size")]).first()
    if any(n > 1 for n in kinds):
        raise ValueError("narrow the records to one family, operation and size first")
    used = records.where((F.col("status") == "ok") & F.col(metric).isNotNull())
    v = F.col(metric).cast("double")
    rows = used.groupBy("label").agg(F.median(v).alias("value"), F.count("*").alias("samples"), F.when(F.count("*") > 1, F.max(v) - F.min(v)).alias("spread")).orderBy("value")
    reason = F.when(F.col("status") != "ok", F.concat(F.lit("status="), "status")).otherwise(f"no {metric}")
    return rows, records.where((F.col("status") != "ok") | F.col(metric).isNull()).select("label", reason.alias("reason"))


def compare_each_group(records: DataFrame, metric: str = "total_time", label: str = "protocol") -> tuple[DataFrame, DataFrame]:
    """``compare_groups`` for each (family, operation, input_size) by itself: its columns after those three, by its rules."""
    if metric not in COMPARABLE:
        raise ValueError(f"{metric} isn't comparable: {COMPARABLE}")
    records = records.withColumn("label", _label(records, label))
    kind = ["family", "operation", "input_size"]
    ok, v = F.coalesce(F.col("status") == "ok", F.lit(False)) & F.col(metric).isNotNull(), F.col(metric).cast("double")
    rows = records.where(ok).groupBy(*kind, "label").agg(F.median(v).alias("value"), F.count("*").alias("samples"), F.when(F.count("*") > 1, F.max(v) - F.min(v)).alias("spread"))
    reason = F.when(F.col("status") == "ok", f"no {metric}").otherwise(F.concat(F.lit("status="), F.coalesce("status", F.lit(""))))
    return rows, records.where(~ok).select(*kind, "label", reason.alias("reason"))


def _last(records: DataFrame, order: str) -> DataFrame:
    return records.groupBy("case").agg(F.max_by(F.struct("status", "wall_ms"), order).alias("r")).select("case", "r.*")


def baseline_compare(current: DataFrame, baseline: DataFrame, warn_ratio: float = WARN_RATIO, order: str = "pos") -> DataFrame:
    """(case, wall_ms, baseline_wall_ms, ratio, flagged, reason) by case, the last row of each side counting."""
    a = _last(current, order).select("case", F.col("status").alias("s1"), F.col("wall_ms").alias("w1"), F.lit(1).alias("in1"))
    b = _last(baseline, order).select("case", F.col("status").alias("s2"), F.col("wall_ms").alias("w2"), F.lit(1).alias("in2"))
    both = a.join(b, "case", "full")
    ok = F.coalesce((F.col("s1") == "ok") & (F.col("s2") == "ok") & F.col("w1").isNotNull() & (F.col("w2") != 0), F.lit(False))
    ratio = F.when(ok, F.bround(F.col("w1") / F.col("w2"), 3))
    reason = F.when(F.col("in1").isNull(), "baseline only").when(F.col("in2").isNull(), "current only").when(~ok, "not compared").when(ratio >= warn_ratio, "slower").otherwise("")
    return both.select("case", F.when(ok, F.col("w1")).alias("wall_ms"), F.when(ok, F.col("w2")).alias("baseline_wall_ms"), ratio.alias("ratio"), F.coalesce(ratio >= warn_ratio, F.lit(False)).alias("flagged"), reason.alias("reason"))


def unexpected_records(records: DataFrame, expected: str = "expected") -> DataFrame:
    """Rows that aren't as expected. An expected deviation may be ok, error or mixed; any other expectation must be met; without
    one (null or empty) a row must be unavailable, or ok and in agreement with the reference."""
    met = F.when(F.col(expected) == "deviation", F.col("status").isin("ok", "error", "mixed")).when(F.coalesce(F.col(expected), F.lit("")) != "", F.col("status") == F.col(expected))
    wanted = met.otherwise((F.col("status") == "unavailable") | ((F.col("status") == "ok") & F.coalesce(F.col("agreement"), F.lit(False))))
    return records.where(~F.coalesce(wanted, F.lit(False)))


QUARTERS = [0.25, 0.5, 0.75]


def sample_stats(records: DataFrame, key: str = "case", value: str = "wall_ms", whole: int = WHOLE) -> DataFrame:
    """(key, n, min, p25, median, p75, max) with linear interpolation; rows without a number are left out.

    A key of more than ``whole`` numbers is counted by ranges of value, not held in one buffer; the percentiles are the same.
    """
    ends = [F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max")]
    found = quantiles(records, [key], value, QUARTERS, whole, ends)
    return found.select(key, "n", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max")


def _spread(v: Column) -> Column:
    """(min, p25, median, p75, max) of the numbers in a group, linearly interpolated; null without any."""
    q = {name: F.percentile(v, F.lit(share)).alias(name) for name, share in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))}
    return F.when(F.count(v) > 0, F.struct(F.min(v).alias("min"), *q.values(), F.max(v).alias("max")))


def summarize_repeats(records: DataFrame, order: str = "pos", whole: int = WHOLE) -> DataFrame:
    """One row a case: runs, status (mixed if they differ), medians and spreads, the run nearest the median, errors, deviation rate.

    Rows: case, pos, status, wall_ms, comm_total_bytes, max_abs_error; comm_send_bytes, comm_recv_bytes and error may be missing.
    Of runs equally near, the first counts; ``error`` is the first text of one. Medians of sent and received bytes need a total.
    A case of more than ``whole`` runs isn't held in one buffer.
    """
    few, many = split_by_size(records, "case", whole)
    out = _summarized(few, order)
    if many is None:
        return out
    numbers = {c: _get(many, c, "double") for c in ("wall_ms", "comm_total_bytes", "comm_send_bytes", "comm_recv_bytes")}
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), v.alias("v")) for c, v in numbers.items()])).alias("item")
    found = quantiles(many.select("case", items).select("case", "item.*"), ["case", "metric"], "v", QUARTERS, whole)
    wide = found.groupBy("case").agg(*[F.max(F.when(F.col("metric") == c, F.col("q"))).alias(c) for c in numbers]).withColumnRenamed("case", "quantile_case")
    return out.unionByName(_summarized(many, order, wide).select(*out.columns))


def _summarized(records: DataFrame, order: str, wide: DataFrame | None = None) -> DataFrame:
    """``summarize_repeats``; wide: the quarters of the four numbers by case, else they are taken from the groups' buffers."""
    per_status = records.groupBy("case", "status").agg(F.count("*").alias("n"))
    states = per_status.groupBy("case").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"), F.when(F.count("*") == 1, F.max("status")).otherwise("mixed").alias("status"))
    error = F.col("max_abs_error").cast("double")
    wall, total = F.col("wall_ms").cast("double"), F.col("comm_total_bytes").cast("double")
    message = _get(records, "error", "string")
    if wide is None:
        middles = [F.median(wall).alias("wall_ms"), _spread(wall).alias("wall_ms_stats"), F.median(total).alias("comm_total_bytes"), _spread(total).alias("comm_total_bytes_stats")]
        middles += [F.when(F.count(total) > 0, F.median(_get(records, c, "double"))).alias(c) for c in ("comm_send_bytes", "comm_recv_bytes")]
    else:
        middles = [f(v).alias(f"{f.__name__}_{c}") for c, v in (("wall", wall), ("total", total)) for f in (F.min, F.max)]
    sums = records.groupBy("case").agg(
        F.count("*").alias("repeat"),
        *middles,
        F.coalesce(F.min_by(message, F.when(message != "", F.col(order))), F.lit("")).alias("error"),
        F.count(error).alias("value_runs"),
        F.max(error).alias("max_abs_error"),
        (F.sum(F.when(error > 0, 1).otherwise(0)) / F.nullif(F.count(error), F.lit(0))).alias("deviation_rate"),
        F.when(F.min((F.col("status") == "ok").cast("int")) == 1, True).alias("agreement"),
    )
    if wide is not None:
        joined = sums.join(wide, F.col("case").eqNullSafe(F.col("quantile_case")), "left")
        quarter = lambda c, k: F.col(c)[k]
        spread = lambda c, name: F.when(F.col(c).isNotNull(), F.struct(F.col(f"min_{name}").alias("min"), quarter(c, 0).alias("p25"), quarter(c, 1).alias("median"), quarter(c, 2).alias("p75"), F.col(f"max_{name}").alias("max")))
        sent = [F.when(F.col("comm_total_bytes").isNotNull(), quarter(c, 1)).alias(c) for c in ("comm_send_bytes", "comm_recv_bytes")]
        sums = joined.select("case", "repeat", spread("wall_ms", "wall").alias("wall_ms_stats"), spread("comm_total_bytes", "total").alias("comm_total_bytes_stats"), *sent, "error", "value_runs", "max_abs_error", "deviation_rate", "agreement", quarter("wall_ms", 1).alias("wall_ms"), quarter("comm_total_bytes", 1).alias("comm_total_bytes"))
    near = records.where("comm_total_bytes is not null").join(sums.select("case", F.col("comm_total_bytes").alias("middle")), "case")
    near = near.groupBy("case").agg(F.min_by(order, F.struct(F.abs(F.col("comm_total_bytes") - F.col("middle")), F.col(order))).alias("nearest_pos"))
    return sums.join(states, "case").join(near, "case", "left").select("case", "repeat", "status", "status_counts", "wall_ms", "comm_total_bytes", "nearest_pos", "value_runs", "max_abs_error", "deviation_rate", "agreement", "wall_ms_stats", "comm_total_bytes_stats", "comm_send_bytes", "comm_recv_bytes", "error")


def best_common_scale(records: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(op, k, variant, cost, samples): at the size that most variants of an operator were measured at (ties: the smaller).

    Costs that are NaN are left out. A variant of more than ``whole`` samples isn't held in one buffer.
    """
    usable = records.where("status = 'ok' and variant is not null and k is not null and cost is not null")
    cover = usable.groupBy("op", "k").agg(F.count_distinct("variant").alias("variants"))
    best = cover.groupBy("op").agg(F.min_by("k", F.struct(-F.col("variants"), F.col("k"))).alias("k"))
    found = quantiles(usable.join(best, ["op", "k"]), ["op", "k", "variant"], "cost", [0.5], whole, [F.count("*").alias("samples")])
    return found.select("op", "k", "variant", F.col("q")[0].alias("cost"), "samples")


def rank_variants(candidates: DataFrame) -> DataFrame:
    """Rows (op, variant, eligible, cost, declared) with place: eligible, then measured, then cheap, then as declared."""
    w = Window.partitionBy("op").orderBy(F.col("eligible").desc(), F.col("cost").isNull(), "cost", "declared")
    return candidates.withColumn("place", F.row_number().over(w))


def cheapest(candidates: DataFrame) -> DataFrame:
    """The first eligible and measured variant of each operator."""
    return rank_variants(candidates.where("eligible and cost is not null")).where("place = 1").drop("place")


def metric_gaps(raw: DataFrame, family: str | None = None) -> DataFrame:
    """(metric, n, declared): for each metric, how many records hold it and whether it is declared as never held."""
    family = family or infer_family(raw)
    held = {m: F.count(F.coalesce(*[_get(raw, c, "string") for c in columns])).alias(m) for m, columns in METRIC_COLUMNS.items()}
    counts = raw.agg(*held.values())
    items = ", ".join(f"'{m}', `{m}`" for m in held)
    return counts.selectExpr(f"stack({len(held)}, {items}) as (metric, n)").withColumn("declared", F.col("metric").isin(MISSING_METRICS[family]))


def unify_job(spark, paths: list[str], out: str | None = None, csv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all files' records in the common columns with their file, status counts a file). Written as JSON to ``out`` and as CSV of
    the common columns alone to ``csv``, where given. A file that holds records of several families fails the job."""
    from cellweave.sources.cells import write_records

    records = reduce(DataFrame.unionByName, [load_records(spark, p, file="file") for p in paths])
    if out:
        write_records(records, out)
    if csv:
        write_records(records, csv, "csv", COMMON)
    return records, status_counts(records, ["file"])


def compare_job(records: DataFrame, metric: str, operation: str | None = None, input_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``compare_groups`` of the unified records of one operation and size, where they are named."""
    for column, wanted in (("operation", operation), ("input_size", input_size)):
        if wanted is not None:
            records = records.where(F.col(column) == wanted)
    return compare_groups(records, metric)
