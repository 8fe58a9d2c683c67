"""Quality gates with quarantine, quality counters, duplicate checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true

Rules = Sequence[tuple[str, Column]]


def quality_gate(df: DataFrame, rules: Rules, run_ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with ``_quality_errors`` and ``_quarantined_at``.

    A rule is (message if it fails, predicate that holds if it passes); an
    unknown predicate fails. Messages are joined by ``"; "`` in rule order.
    """
    passes = [(text, is_true(p)) for text, p in rules]
    ok = F.lit(True)
    for _, p in passes:
        ok = ok & p
    errors = F.concat_ws("; ", *[F.when(~p, F.lit(text)) for text, p in passes])
    ts = F.current_timestamp() if run_ts is None else run_ts
    return df.where(ok), df.where(~ok).select("*", errors.alias("_quality_errors"), ts.alias("_quarantined_at"))


def quality_report(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """One row: for each name, how many rows are bad. Null, not 0, over an empty frame."""
    return df.select(*[F.sum(F.when(p, 1).otherwise(0)).alias(name) for name, p in bad.items()])


def duplicate_keys(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).count().where(F.col("count") > 1)


def rescued_rows(df: DataFrame, column: str = "_rescued_data") -> DataFrame:
    return df.where(F.col(column).isNotNull())
