"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import (
    chunk_bpe, count_cache, cross_align, id_files, license_align, loglik, odd_sketch, phrase_index, pii, quality_knn, source_audit,
    suffix_dedup, toxicity,
)
from strideframe.llm.frames import table
from strideframe.llm.oracles import ORACLES  # noqa: F401
from strideframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}



def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return id_files.crc32_of_ids(id_files.read_ids(spark, path))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_cache.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "counts"))


@query
def op1_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return chunk_bpe.decode(chunk_bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer, digests=True).drop("ids")


@query
def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("h")


@query
def op4_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h", "evidence")


@query
def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglik.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


@query
def op7_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("h", "component_h")


@query
def op5_license_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_align.summary(license_align.scan(table(spark, sf_dir, "documents")))


@query
def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents")).drop("h")
