"""The registered queries of the corpus operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import byte_bpe, conversation_repair, decontaminate, hmm_lm, jaccard_join, langid, licenses, line_dedup, oracles, quality_crf, quality_rules, substring_dedup, token_alignment, token_counts

QUERIES = {}
ORACLE_SQL = {"op2_substring_dedup": oracles.SUBSTRING_DEDUP, "op3_jaccard_join": oracles.JACCARD_JOIN, "op5_decontaminate": oracles.DECONTAMINATE, "op11_line_dedup": oracles.LINE_DEDUP, "op12_conversation_repair": oracles.CONVERSATION_REPAIR, "quality_rule_counts": oracles.RULE_COUNTS}
TOKEN_LIMIT = 4096


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def crc_is(divisor: int, remainder: int):
    """True where crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))


def hex_sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@query
def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_is(5, 0))
    field = quality_crf.train(docs.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~crc_is(5, 0)))
    return quality_crf.score(docs, field, lines=False).select("doc_id", "held_out", "score", (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", hex_sha256("kept_text").alias("kept_sha256"))


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang").withColumn("held_out", crc_is(4, 2))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op9_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_is(7, 2)).withColumn("train", ~F.col("held_out"))
    return hmm_lm.score(docs, "train").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir), licenses.train())
    sure = F.filter("paragraphs", lambda p: p["confirmed"])
    best = F.coalesce(F.array_max(F.transform(sure, lambda p: p["chance"])), F.lit(0.0))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size(sure).cast("long").alias("n_confirmed"), F.col("unknown").alias("n_unknown"), best.alias("best_chance"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", hex_sha256("kept_text").alias("kept_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as operator 12's contract damages them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    marked = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), again).drop("again")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(damaged(turns), ids=turns)


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 4 counts, which SQL can express; its verdict can't be."""
    counted = quality_rules.statistics(documents(spark, sf_dir))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))
