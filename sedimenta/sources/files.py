"""Batch readers and writers of landed files, and lineage columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import storage

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
SHOW_SCHEMA = "id bigint, name string, status string, rating struct<average:double>, genres array<string>, language string, premiered string"


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None, infer: bool = False, **options) -> DataFrame:
    """CSV with a header and quoted line breaks; all columns strings unless a schema is given or inferred.

    ``multiLine=False`` lets Spark split large files, where no field has line breaks.
    """
    reader = spark.read.options(**(CSV_OPTIONS | {"inferSchema": infer} | options))
    return (reader.schema(schema) if schema else reader).csv(paths)


def read_first_available(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """The first path that can be read and has a row; the last error if none has."""
    last: Exception = ValueError("no candidate path")
    for path in paths:
        try:
            df = read_csv(spark, path, **options)
            if not df.isEmpty():
                return df
            last = ValueError(f"{path} has no rows")
        except AnalysisException as e:
            last = e
    raise last


def flatten_shows(df: DataFrame) -> DataFrame:
    """Nested show records to flat columns; missing ratings are null, genres one text."""
    return df.select(
        F.col("id").alias("tvmaze_id"), "name", "status", F.col("rating.average").cast("double").alias("rating"),
        F.array_join(F.coalesce("genres", F.array().cast("array<string>")), ", ").alias("genres"), "language", "premiered",
    )


def read_shows(spark: SparkSession, path: str) -> DataFrame:
    return flatten_shows(spark.read.schema(SHOW_SCHEMA).option("multiLine", True).json(path))


def source_file() -> Column:
    return F.col("_metadata.file_path")


def add_lineage(df: DataFrame, run_ts: Column | None = None, path: Column | None = None) -> DataFrame:
    """Adds ``_source_file``, ``_ingested_at`` and ``_load_date``; ``run_ts`` is now by default."""
    ts = F.current_timestamp() if run_ts is None else run_ts
    return df.select("*", (source_file() if path is None else path).alias("_source_file"), ts.alias("_ingested_at"), F.to_date(ts).alias("_load_date"))


def split_to_files(df: DataFrame, path: str, n: int) -> None:
    """Deals ``df`` out evenly to ``n`` CSV files with headers."""
    df.repartition(n).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def drop_csv(df: DataFrame, folder: str, name: str) -> str:
    """Writes a small frame as one CSV file of a chosen name."""
    spark, temp = df.sparkSession, storage.scratch(df.sparkSession, "drop")
    df.coalesce(1).write.options(header=True, quote='"', escape='"').csv(temp)
    part = next(x for x in storage.children(spark, temp) if x.startswith("part-"))
    fs, target = storage._fs(spark, folder)
    fs.mkdirs(target)
    storage.move(spark, f"{temp}/{part}", f"{folder}/{name}")
    storage.delete(spark, temp)
    return f"{folder}/{name}"
