"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool.llm import line_dedup, media, mixing, near_dedup, ngram, packing, periodic, quality_model, quality_rules, repeats, secret_scan, token_counts, turn_repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.copies(media.pictures(table(spark, sf_dir, "embeddings")))
    # a scene of each vector, and of every eighth an edited copy too
    return found.select(F.floor(F.col("id") / 2).alias("vec_id"), (F.pmod("id", F.lit(2)) == 1).alias("edited"), "format", "decoded", "n_corners", "class_id", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.planted(table(spark, sf_dir, "documents")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), copies="copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_copies, op2_token_counts, op3_repeats, op4_quality_model, op5_near_dedup, op6_mixing, op7_quality_rules, op8_line_dedup, op9_lm_scoring, op10_packing, op11_secrets, op12_periodic_runs, op13_turn_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.sql(), "op11_secrets": secret_scan.sql()}
