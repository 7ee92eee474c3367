"""Queries of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.line_dedup import ORACLE_SQL as line_dedup_sql


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").cast("long").alias("lines"), F.col("_cut_lines").cast("long").alias("cut_lines"), "text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard

    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_ann": op5_ann,
    "op6_html_text": op6_html_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_lm_score": op10_lm_score,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup_sql,
}
