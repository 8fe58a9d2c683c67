"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before has kept; stages are written as Parquet to the shared folder and
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from sedimenta.llm.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects: null and empty texts are judged as empty ones, repeated rows alike."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat across documents; ``n_chars`` follows the text. Null texts stay null, rows without an id stay as they are."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8). Texts without words and rows without an id stay; rows that repeat an id and text stay or go together."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row, or a whole shorter item, with the benchmark. Null texts and rows without an id stay; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources in equal shares; a null source is one of them. An empty table stays empty in this and every stage."""
    return mixing.mix_sources(docs, max_rate=None)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mixing", mixing_stage),
]

#: No SQL: two stages learn from data or sketch it. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
