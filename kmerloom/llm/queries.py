"""The queries opN_<name> over the synthetic tables, each with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .chat_format import SCHEMAS, calls_of_turns, link_tool_calls
from .chunk_dedup import chunk_dedup
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle
from .mixing import mix
from .part_enum import part_enum_components
from .piece_codec import encode
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity


def held_out(modulus: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(4, 2))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*calls_of_turns(table(spark, sf_dir, "conversations")), SCHEMAS)


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(5, 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("posterior")  # the SQL has no such column


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op11_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum_components(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def queries() -> dict:
    found = (
        op1_mix_sources, op2_simhash, op3_quality_classifier, op4_exact_dedup, op5_suffix_dedup,
        op6_chat_format, op7_chunk_dedup, op8_toxicity, op9_quality_rules, op10_piece_codec, op11_part_enum, op12_fill_in_middle,
    )
    return {f.__name__: f for f in found}
