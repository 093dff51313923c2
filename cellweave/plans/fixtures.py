"""Views of the driver tables in the shapes that the operators take, as frames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.sources import cells as source

ORIGIN = "2024-01-01 00:00:00+00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_cells(spark, d) -> DataFrame:
    return source.lineitem_cells(table(spark, d, "lineitem"))


def parts_of(spark, d, id="l_suppkey") -> DataFrame:
    return source.lineitem_cells(table(spark, d, "lineitem"), quantity=False, id=id)


def cell_weights(spark, d) -> DataFrame:
    items = source.lineitem_cells(table(spark, d, "lineitem").withColumn("set_id", F.col("l_linenumber")), id="l_linenumber")
    return items.groupBy("grid_code").agg((F.min("set_id") * 10).cast("bigint").alias("value"))


def part_bands(spark, d) -> DataFrame:
    low = F.col("p_size") * 10 + F.lit(0.5)
    return table(spark, d, "part").select(F.col("p_partkey").alias("band_id"), F.pmod("p_partkey", F.lit(65536)).alias("x"), F.col("p_size").alias("y"), low.alias("height_min"), (low + F.col("p_retailprice")).alias("height_max"), (15 + F.pmod("p_partkey", F.lit(5))).cast("int").alias("level"), F.lit(0).alias("toff"), F.lit(0).alias("lt"))


def event_nodes(spark, d) -> DataFrame:
    lt = F.pmod("event_id", F.lit(4)).cast("int")
    t = F.pmod(codes.toff_lenient("ts", ORIGIN), F.lit(16384))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("interval_id"), (t - F.pmod(t, F.call_function("shiftleft", F.lit(1).cast("bigint"), lt))).alias("toff"), lt.alias("lt"))


def order_windows(spark, d) -> DataFrame:
    start = F.pmod(F.col("o_orderkey") * 7, F.lit(10000))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("interval_id"), start.alias("start"), (start + F.pmod("o_custkey", F.lit(500)) + 1).alias("end"))


def bin_vectors(spark, d) -> DataFrame:
    bins = F.transform("embedding", lambda x: codes.quantize(x, -1.0, 1.0))
    return table(spark, d, "embeddings").select("vec_id", "label", bins.alias("values"), F.lit(1).alias("scale"))


def run_log(spark, d) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("case"), F.concat(F.lit("v"), F.pmod("user_id", F.lit(5))).alias("variant"), F.pmod(n, F.lit(4)).alias("k"), F.col("value").alias("wall_ms"), F.when(n % 17 == 0, "error").when(n % 23 == 0, "unavailable").otherwise("ok").alias("status"), n.alias("pos"), F.col("value").alias("cost"), (n % 100 * 8).alias("comm_total_bytes"), F.when(n % 11 == 0, F.col("value") / 100).otherwise(0.0).alias("max_abs_error"))


def named_inputs(spark, d) -> DataFrame:
    plain = F.replace(F.col("n_name"), F.lit("_"), F.lit(""))
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), F.pmod(key, F.lit(4)) + 1)
    left = F.concat(pick(["route", "path", "track", "flight"], "n_nationkey"), F.lit("_"), plain)
    right = F.concat(pick(["zone", "area", "region", "buffer"], "n_regionkey"), F.lit("_"), plain)
    level = F.get(F.array(*map(F.lit, ["public", "internal", "sensitive", "secret"])), F.pmod("n_nationkey", F.lit(5)))
    return table(spark, d, "nation").select("n_nationkey", "n_regionkey", left.alias("left_name"), right.alias("right_name"), F.concat(F.lit("p"), F.pmod("n_regionkey", F.lit(2))).alias("party_id"), level.alias("sensitivity"))


def customer_inputs(spark, d) -> DataFrame:
    """``named_inputs`` for each customer: names by nation, the number by customer."""
    return table(spark, d, "customer").join(named_inputs(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))


def one_set(spark, d) -> DataFrame:
    """All items as one set, with their positions."""
    items = table(spark, d, "lineitem")
    return items.select(F.lit(0).cast("bigint").alias("set_id"), codes.encode_cell(F.col("l_orderkey") % 131072, 0, F.col("l_quantity").cast("bigint"), 0, 0, 0).alias("grid_code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


# --- the same for DuckDB --------------------------------------------------------------------------------------------

CELLS = "SELECT l_suppkey AS set_id, ((l_partkey % 65536) << 47) | (CAST(l_quantity AS BIGINT) << 23) | (15::BIGINT << 18) AS grid_code FROM lineitem"
PARTS = "SELECT {id} AS set_id, (l_partkey % 65536) << 47 AS grid_code FROM lineitem"
WEIGHTS = "SELECT ((l_partkey % 65536) << 47) | (CAST(l_quantity AS BIGINT) << 23) | (15::BIGINT << 18) AS grid_code, CAST(min(l_linenumber) * 10 AS BIGINT) AS value FROM lineitem GROUP BY 1"
BANDS = "SELECT p_partkey AS band_id, p_partkey % 65536 AS x, p_size AS y, p_size * 10 + 0.5::DOUBLE AS height_min, p_size * 10 + 0.5::DOUBLE + p_retailprice AS height_max, CAST(15 + p_partkey % 5 AS INT) AS level FROM part"
NODES = "SELECT event_id, interval_id, (t >> lt) << lt AS toff, lt FROM (SELECT event_id, user_id AS interval_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0) AS BIGINT) % 16384 AS t, CAST(event_id % 4 AS INT) AS lt FROM events)"
WINDOWS = 'SELECT o_orderkey AS interval_id, o_orderkey * 7 % 10000 AS "start", o_orderkey * 7 % 10000 + o_custkey % 500 + 1 AS "end" FROM orders'
VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1.0) / 2.0 * 255.0 + 0.5) AS BIGINT)) AS \"values\" FROM embeddings"
RUNS = "SELECT event_type AS \"case\", 'v' || (user_id % 5) AS variant, event_id % 4 AS k, value AS wall_ms, CASE WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 23 = 0 THEN 'unavailable' ELSE 'ok' END AS status, event_id AS pos, value AS cost, event_id % 100 * 8 AS comm_total_bytes, CASE WHEN event_id % 11 = 0 THEN value / 100 ELSE 0.0 END AS max_abs_error FROM events"
ONE_SET = "SELECT 0::BIGINT AS set_id, ((l_orderkey % 131072) << 47) | (CAST(l_quantity AS BIGINT) << 23) AS grid_code, l_orderkey * 10 + l_linenumber AS pos FROM lineitem"
NAMES = "SELECT n_nationkey, n_regionkey, (['route','path','track','flight'])[n_nationkey % 4 + 1] || '_' || replace(n_name, '_', '') AS left_name, (['zone','area','region','buffer'])[n_regionkey % 4 + 1] || '_' || replace(n_name, '_', '') AS right_name, 'p' || (n_regionkey % 2) AS party_id, (['public','internal','sensitive','secret'])[n_nationkey % 5 + 1] AS sensitivity FROM nation"


def cell_deg(level: str) -> str:
    return f"(CASE WHEN {level} <= 9 THEN pow(2.0, 9 - {level}) WHEN {level} <= 15 THEN pow(2.0, 15 - {level}) / 60.0 WHEN {level} <= 21 THEN pow(2.0, 21 - {level}) / 3600.0 ELSE pow(2.0, 32 - {level}) / 2048.0 / 3600.0 END)"


def height_index(height: str, level: str) -> str:
    return f"CAST(floor(ln(1.0 + ({height}) / {codes.EARTH_RADIUS}) / ln(1.0 + pi() / 180) / {cell_deg(level)}) AS BIGINT)"


def layer_lower(layer: str, level: str) -> str:
    return f"({codes.EARTH_RADIUS} * (pow(1.0 + pi() / 180, ({layer}) * {cell_deg(level)}) - 1.0))"


CUSTOMER_NAMES = f"SELECT * FROM customer JOIN ({NAMES}) ON c_nationkey = n_nationkey"
