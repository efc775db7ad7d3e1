"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillscope.llm import (
    bpe,
    common,
    embedding_dedup,
    language,
    license_scan,
    line_dedup,
    minhash,
    mixing,
    periodic,
    quality,
    simhash,
    toxicity,
    url_filter,
    whitening,
)
from tillscope.llm.sql import ORACLES as _SQL
from tillscope.sources import read_parquet


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_parquet(spark, folder, "embeddings"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    planned = mixing.with_copies(sized, mixing.source_rates(docs))
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        common.held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op3_score_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    model = quality.train(docs, read_parquet(spark, folder, "labels"))
    return _predicted(quality.add_score(docs, model), quality.THRESHOLD)


def op4_score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    model = toxicity.train(docs, read_parquet(spark, folder, "labels"))
    return _predicted(toxicity.add_score(docs, model), toxicity.THRESHOLD)


def op5_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.group(read_parquet(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return grouped.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_filter_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_parquet(spark, folder, "pages")
    return url_filter.filter_urls(pages, url_filter.rules(spark))


def op7_dedup_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(read_parquet(spark, folder, "documents"))


def op8_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compare_edited(read_parquet(spark, folder, "documents"))


def op9_encode_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read_parquet(spark, folder, "documents"), bpe.public_file())


def op10_scan_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(read_parquet(spark, folder, "documents"))


def op11_whiten_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    # The operator's deviation is a decimal; as a long it is NULL where 64 bits do not hold it.
    found = whitening.whiten(read_parquet(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_find_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.report(periodic.plant_runs(read_parquet(spark, folder, "documents")))


def op13_predict_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    found = language.add_language(docs, language.train(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_mix_sources": op2_mix_sources,
    "op3_score_quality": op3_score_quality,
    "op4_score_toxicity": op4_score_toxicity,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_filter_urls": op6_filter_urls,
    "op7_dedup_lines": op7_dedup_lines,
    "op8_minhash_fingerprints": op8_minhash_fingerprints,
    "op9_encode_bpe": op9_encode_bpe,
    "op10_scan_licenses": op10_scan_licenses,
    "op11_whiten_embeddings": op11_whiten_embeddings,
    "op12_find_periodic_runs": op12_find_periodic_runs,
    "op13_predict_language": op13_predict_language,
    "pipeline": corpus_pipeline.run,
}

ORACLES = dict(_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
