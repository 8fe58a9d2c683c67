"""Counts, file audits, enrichment and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from ..functions.scalars import base_name
from ..sources import storage

#: A dimension of at most this many rows and bytes (as JSON) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per group, largest first; ties by key."""
    return df.groupBy(*keys).count().orderBy(F.desc("count"), *keys)


def file_audit(df: DataFrame, path: str = "_source_file", ts: str = "_ingested_at", by_name: bool = False) -> DataFrame:
    """Rows and first and last ``ts`` of every source file, by its path or its base name."""
    key = base_name(path) if by_name else F.col(path)
    return df.groupBy(key.alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_delta(before: DataFrame, after: DataFrame) -> int:
    return after.count() - before.count()


def enrich(df: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a dimension. It is broadcast only if its rows and bytes, as counted, are within the bounds."""
    some = dimension.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("size"))
    rows, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return df.join(F.broadcast(dimension) if small else dimension, list(on), "left")


def top_rated(df: DataFrame, rating: str, *ties: str) -> DataFrame:
    return df.where(F.col(rating).isNotNull()).orderBy(F.desc(rating), *ties)


def with_position(df: DataFrame, name: str) -> DataFrame:
    """``df``, which is sorted, with each row's place from 1 in ``name``; rows are counted by partition, not gathered.

    A sort that runs again may cut its ranges elsewhere, so it runs once: its
    rows are staged with their places within partitions. They come back in no
    order; ``name`` tells it.
    """
    own = free_prefix([*df.columns, name])
    part, at = F.col(f"{own}part"), F.col(f"{own}at").bitwiseAND(F.lit((1 << 33) - 1))
    marked = storage.staged(df.withColumns({f"{own}part": F.spark_partition_id(), f"{own}at": F.monotonically_increasing_id()}), "places")
    held = {r[0]: r[1] for r in marked.groupBy(part).agg(F.max(at) + 1).collect()}  # a row for each partition
    before, total = [], 0
    for p in range(max(held, default=-1) + 1):
        before.append(total)
        total += held.get(p, 0)
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in before or [0]]), part)
    return marked.withColumn(name, offset + at + 1).drop(f"{own}part", f"{own}at")
