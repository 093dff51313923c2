"""A corpus from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of ``documents``. ``run``
writes each stage's result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import byte_bpe, decontaminate, jaccard_join, langid, substring_dedup
from cellweave.llm.durable import discard, saved, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies are documents that share so much of their five-word shingles.
SHINGLE, PERCENT = 5, 80
#: Keys of at most so many rows that go are broadcast (16 bytes each).
BROADCAST_KEYS = 2_000_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (null texts, those without a letter, and those that two languages'
    codewords fit about as well); the others' ``lang`` becomes the predicted one."""
    found = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    told = found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: of smallest id (rows without an id come last), then least hash of the text.

    Rows are told apart by id and text, so of rows that share an id only the copies go; of rows that are equal in both, one
    stays. Texts without a word are no copies of each other: all stay.
    """
    found = jaccard_join.detailed_components(docs.select("doc_id", "text"), SHINGLE, PERCENT).where("component is not null")
    found = saved(found.groupBy("component", "least", "id", "tie").agg(F.count("*").alias("n")))
    # Most rows go by their own id alone; only rows of the smallest one are compared by their texts' hashes.
    may_stay = F.col("least").eqNullSafe(F.col("id"))
    first = found.where(may_stay).groupBy("component").agg(F.min("tie").alias("first"))
    later = found.where(may_stay).join(first, "component").where("tie <> first")
    gone = saved(found.where(~may_stay).select("id", "tie").union(later.select("id", "tie")))
    again = saved(found.where(may_stay & (F.col("n") > 1)).join(gone, [found.id.eqNullSafe(gone.id), found.tie == gone.tie], "left_anti").select("id", "tie"))
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("tie"))

    def match(keys: DataFrame, how: str) -> DataFrame:
        # Keys alone are sent to every task while they are few; beyond that, both sides are shuffled.
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return keyed.join(keys.withColumnsRenamed({"id": "key", "tie": "key_tie"}), F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("tie") == F.col("key_tie")), how)

    if again.isEmpty():
        return match(gone, "left_anti").select(*COLUMNS)
    once = match(again, "left_semi").dropDuplicates(["doc_id", "text"])
    return match(gone.union(again), "left_anti").union(once).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds too. A document that loses nothing keeps its text; one that loses all goes."""
    found = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in benchmark passages."""
    found = decontaminate.find(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    found = byte_bpe.encode(docs.select(*COLUMNS), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("token_ids", token_ids),
]

#: Language prediction, near-duplicate groups and token ids have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        # What a stage wrote on its way, and the table that it read, aren't needed once its result is written.
        with scratch(spark) as keep:
            docs = keep(saved(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
