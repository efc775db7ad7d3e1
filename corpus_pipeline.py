"""The corpus pipeline: every stage takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillscope.llm import bpe, line_dedup, mixing, simhash, toxicity
from tillscope.sources import read_parquet, written_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learnt from the labelled ones among them calls toxic go."""
    return toxicity.drop_toxic(docs, read_parquet(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from all but their first place; every document stays."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources reach their weights."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.public_file(), keep_ids=True)


#: Each stage is written as Parquet and read again as the next one's documents.
STAGES = [
    ("toxicity", drop_toxic),
    ("lines", dedup_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: The first stage is a learnt model and the last a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between two stages is stored in the shared folder."""
    docs = read_parquet(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
