"""A training-corpus pipeline: five stages, each of which reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scarp.llm import decontaminate, mixing, quality, queries, simhash, tokens
from scarp.llm.common import materialize, new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules and trees reject; null and short texts go, whatever columns there are stay."""
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group; texts without words are one group, of equal rows one stays."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark window; null texts hold none, an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until every source has its target share; null is a source, empty texts are taken once."""
    return mixing.take(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return what is read back from them, a row for each copy; an empty table gives none."""
    path = new_path(spark, "tokens")
    tokens.write_tokens(docs, path, queries.tokenizer_path())
    return tokens.read_tokens(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
    ("token_output", token_files),
]

#: Trees, connected components, Newton iterations and a tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what its predecessor wrote; only doc_id, text and source need be there."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
