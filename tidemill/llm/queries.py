"""The registered queries of the text operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, decontaminate, line_dedup, packing, personal_data, quality_rules, secrets, simhash_dedup, substring_dedup, token_counts, token_output

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.drop("tiles")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    digests = cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_packing.pack(digests)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.assess(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[n for n, _ in quality_rules.COUNTS], "base_failed", "kept", "lost_chars")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_rows(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secrets(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "rule", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents")).drop("removed")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_best_fit_packing, op3_token_counts, op4_personal_data, op5_quality_rules, op6_token_output, op7_simhash_near_dedup, op8_secret_scan, op9_line_dedup, op10_substring_dedup)}
