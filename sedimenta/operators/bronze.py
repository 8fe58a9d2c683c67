"""Bronze columns, batch stamps and controlled change batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import row_hash


def bronze_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as strings."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with each absent column of ``columns`` (name -> type) added as nulls."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def stamp_batch(df: DataFrame, batch: str, sequence: int, system: str, hashed: Sequence[str], run_ts: Column | None = None) -> DataFrame:
    """Adds batch id, sequence, source system, ingest time and the raw row's hash."""
    return df.withColumns({
        "_batch_id": F.lit(batch), "_ingestion_sequence": F.lit(sequence).cast("bigint"), "_source_system": F.lit(system),
        "_ingested_at": F.current_timestamp() if run_ts is None else run_ts, "_raw_hash": row_hash(hashed),
    })


def slice_keys(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    return df.where(F.col(key).isin(*values))


def restamp(df: DataFrame, batch: str, sequence: int, changes: dict[str, Column] | None = None, hashed: Sequence[str] | None = None) -> DataFrame:
    """Stamped rows again, as part of another batch, with ``changes``; the raw hash is inherited unless ``hashed`` names its columns."""
    out = df.withColumns(changes) if changes else df
    out = out.withColumns({"_batch_id": F.lit(batch), "_ingestion_sequence": F.lit(sequence).cast("bigint")})
    return out.withColumn("_raw_hash", row_hash(hashed)) if hashed else out
