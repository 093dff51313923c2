"""Relation tables: who relates to whom, by which predicate, where, when and how sensitive that is."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import codes

# Operators with the predicate, its family and whether its sides can be swapped.
PREDICATES = [
    ("Intersects", "Intersects", "spatial-set", True),
    ("Contains", "Contains", "spatial-set", False),
    ("DistanceLE", "DistanceLE", "spatial-metric", False),
    ("CellSetIntersect", "Intersects", "spatial-set", True),
    ("TemporalOverlap", "TemporalOverlap", "temporal-interval", True),
    ("WeightedSum", "WeightedSum", "attribute-aggregate", False),
]
# Parts of a name that make it a relation's object.
OBJECT_HINTS = ["zone", "no_fly", "nfz", "area", "region", "restrict", "buffer"]
# Business words for operators, in the order in which they are tried.
ALIASES = {
    "Intersects": ["intersect", "intersection", "crosses", "touches", "overlaps", "overlap", "conflict", "collide"],
    "Contains": ["within", "covers", "inside", "buffer", "contains"],
    "DistanceLE": ["distance", "near", "close_to", "distance_lt", "within_distance", "proximity", "nearest"],
    "CellSetIntersect": ["cell_intersect", "cells_intersect", "grid_intersect"],
    "WeightedSum": ["sum", "weighted_total", "score", "risk_score", "aggregate", "density", "kde", "estimate", "cluster", "centroid"],
    "TemporalOverlap": ["time_overlap", "temporal_intersect", "overlaps_time", "时间重叠", "schedule", "window"],
    "HeightBand": ["height", "height_band", "heightband", "altitude_band", "elevation_band", "vertical_band", "layer", "height_layer", "高度带", "高度层", "海拔带"],
}
# Levels of sensitivity, the least sensitive first.
LEVELS = ["public", "internal", "sensitive", "secret"]
# Names that carry a scope, and the parameters that carry a time, in the order in which they are tried.
SCOPE = "^(?:route|path|traj|track|flight|zone|area|region)_([A-Za-z0-9]+)$"
TIMES = ["time", "time_scope", "temporal_scope", "window"]


def relations_from_pairs(pairs: DataFrame, predicate: str, subject: str = "left_id", object: str = "right_id", sensitivity: str = "internal", meta: dict[str, str] | None = None) -> DataFrame:
    """Any pair result as relations; ``meta`` names columns to carry as text."""
    absent = F.lit(None).cast("string")
    items = F.create_map(*chain.from_iterable((F.lit(k), F.col(v).cast("string")) for k, v in (meta or {}).items())) if meta else F.create_map().cast("map<string,string>")
    return pairs.select(F.col(subject).cast("string").alias("subject"), F.lit(predicate).alias("predicate"), F.col(object).cast("string").alias("object"), absent.alias("time"), absent.alias("spatial_scope"), F.lit(sensitivity).alias("sensitivity"), absent.alias("confidence"), items.alias("meta"))


def relation_view(relations: DataFrame) -> DataFrame:
    """The six public fields, and subject | predicate | object as text."""
    return relations.select("subject", "predicate", "object", "time", "spatial_scope", "sensitivity", F.concat_ws(" | ", "subject", "predicate", "object").alias("triple"))


def split_subject_object(names) -> Column:
    """struct(subject, object) of an array of input names: a name that hints at a zone is the object wherever it stands."""
    n = F.col(names) if isinstance(names, str) else names
    hinted = F.get(F.filter(n, lambda x: F.lower(x).rlike("|".join(OBJECT_HINTS))), F.lit(0))
    other = F.get(F.filter(n, lambda x: x != hinted), F.lit(0))
    subject = F.when(F.size(n) == 0, "<none>").when(F.size(n) == 1, F.get(n, F.lit(0))).when(hinted.isNull(), F.get(n, F.lit(0))).otherwise(F.coalesce(other, F.get(n, F.lit(0))))
    target = F.when(F.size(n) == 0, "<none>").when(F.size(n) == 1, "<literal>").otherwise(F.coalesce(hinted, F.get(n, F.lit(1))))
    return F.struct(subject.alias("subject"), target.alias("object"))


def spatial_scope(names) -> Column:
    """The part after the underscore of the first name of the kind route_X or zone_X; null without one."""
    n = F.col(names) if isinstance(names, str) else names
    return F.get(F.filter(F.transform(n, lambda x: F.regexp_extract(x, SCOPE, 1)), lambda x: x != ""), F.lit(0))


def temporal_scope(params) -> Column:
    m = F.col(params) if isinstance(params, str) else params
    return F.coalesce(*[F.element_at(m, k) for k in TIMES])


def scope_text(spatial, temporal) -> Column:
    s, t = (F.col(x) if isinstance(x, str) else x for x in (spatial, temporal))
    return F.when(s.isNull() & t.isNull(), F.lit(None)).otherwise(F.concat_ws(" @ ", s, t))


def predicate_table(spark) -> DataFrame:
    return spark.createDataFrame(PREDICATES, "op string, predicate string, family string, symmetric boolean")


def predicate_info(calls: DataFrame, op: str = "op") -> DataFrame:
    """Rows with predicate, family and symmetric of their operator; null for unknown ones. The table has six rows."""
    return calls.join(F.broadcast(predicate_table(calls.sparkSession).withColumnRenamed("op", op)), op, "left")


def sensitivity_rank(level) -> Column:
    """0 to 3; what isn't known counts as secret."""
    x = F.col(level) if isinstance(level, str) else level
    rank = F.when(x == LEVELS[0], 0)
    for k, name in enumerate(LEVELS[1:], 1):
        rank = rank.when(x == name, k)
    return rank.otherwise(3)


def sensitivity_name(rank) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank)


def max_sensitivity(levels) -> Column:
    """The most sensitive of an array; of none: internal."""
    x = F.col(levels) if isinstance(levels, str) else levels
    return F.when(F.size(x) == 0, "internal").otherwise(sensitivity_name(F.array_max(F.transform(x, sensitivity_rank))))


def max_sensitivity_by(rows: DataFrame, key: str, level: str = "sensitivity") -> DataFrame:
    return rows.groupBy(key).agg(F.max(sensitivity_rank(level)).alias("rank")).select(key, sensitivity_name(F.col("rank")).alias("sensitivity"))


def needs_protection(level) -> Column:
    return sensitivity_rank(level) >= LEVELS.index("sensitive")


def default_sensitivity(geo_type) -> Column:
    t = F.col(geo_type) if isinstance(geo_type, str) else geo_type
    return F.when(t.isin("Scalar", "Bool"), "public").when(t == "Relation", "internal").otherwise("sensitive")


def alias_table(spark) -> DataFrame:
    rows = [(alias, op) for op, words in ALIASES.items() for alias in words]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, alias string, op string")


def suggest_ops(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, ops): operators whose alias contains the word or is contained in it, in table order, each once.

    The aliases are one literal array, so every word is compared where it stands.
    """
    pairs = [(alias, op) for op, aliases in ALIASES.items() for alias in aliases]
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(o).alias("op")) for a, o in pairs])
    low = F.lower(word)
    hits = F.filter(table, lambda p: F.contains(low, p["alias"]) | F.contains(p["alias"], low))
    return words.withColumn("ops", F.array_distinct(F.transform(hits, lambda p: p["op"])))


# Types of entities that are geometric, with or without cells.
GEOMETRIC = ["EntitySet", "CellSet", "Point", "Vector"]


def entity_table(entities: DataFrame) -> DataFrame:
    """Entity rows with n_codes, is_geometric (by type alone), scope (an override wins) and all_valid (no code is missing)."""
    return entities.withColumn("n_codes", F.size("cell_codes")).withColumn("is_geometric", F.col("entity_type").isin(GEOMETRIC)).withColumn("scope", F.coalesce("new_scope", "spatial_scope")).withColumn("all_valid", F.forall("cell_codes", lambda c: c.isNotNull()))


def party_binding(inputs: DataFrame, most: int = 2) -> DataFrame:
    """(party_id, rank, inputs) by first sight (rows: position, input_name, party_id); inputs without a party are passed over.

    More than ``most`` parties raise when the rank is read. Parties are few, so ranking them is a single small window.
    """
    named = inputs.where(F.trim("party_id") != "").withColumn("party_id", F.trim("party_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "input_name"))), lambda s: s["input_name"])
    found = named.groupBy("party_id").agg(F.min("position").alias("first"), ordered.alias("inputs"))
    rank = F.row_number().over(Window.orderBy("first")) - 1
    return found.withColumn("rank", rank).withColumn("rank", codes.checked(F.col("rank"), F.col("rank") < most, "more parties than supported", True)).select("party_id", "rank", "inputs")


def same_party(left, right) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    return F.coalesce((a != "") & (a == b), F.lit(False))
