"""Scalar expressions. All are built-ins, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

#: The long date's pattern, the number that starts a duration, and the unit behind its first number.
LONG_DATE, LEADING_NUMBER, UNIT = "MMMM d, yyyy", r"^(\d+)", r"\d+\s+(.*)$"


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_string(c: ColumnLike) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def parse_long_date(c: ColumnLike) -> Column:
    """``July 27, 2026`` to a date; null for anything else, under ANSI mode too."""
    return F.try_to_date(F.trim(_col(c)), LONG_DATE)


def try_int(c: ColumnLike) -> Column:
    return _col(c).try_cast("int")


def parse_duration(c: ColumnLike) -> tuple[Column, Column, Column]:
    """Raw text, leading number and unit of ``90 min`` or ``2 Seasons``.

    The number has to start the untrimmed text. The unit is what follows the
    first digits and blanks anywhere, ``''`` if nothing does, null for null.
    """
    text = _col(c)
    value = F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("int")
    return clean_string(text), value, F.regexp_extract(text, UNIT, 1)


def base_name(path: ColumnLike) -> Column:
    return F.regexp_extract(_col(path), "[^/]+$", 0)


def row_hash(columns: Sequence[ColumnLike], strict: bool = False) -> Column:
    """SHA-256 of columns as text, joined by two pipes.

    By default null and ``''`` hash alike. ``strict`` tells them apart and
    puts each value's length before it, so that no two rows can meet by way of
    a delimiter in a value.
    """
    texts = [_col(c).cast("string") for c in columns]
    if strict:
        texts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat_ws("||", *[F.coalesce(t, F.lit("")) for t in texts]), 256)


def is_true(predicate: Column) -> Column:
    """The predicate with unknown counted as false."""
    return F.coalesce(predicate, F.lit(False))


def allowed(c: ColumnLike, values: Sequence) -> Column:
    return is_true(_col(c).isin(*values))


def year_in_range(c: ColumnLike, first: int = 1900, as_of: Column | None = None) -> Column:
    """From ``first`` to the year after ``as_of`` (a date; today by default)."""
    return is_true(_col(c).between(F.lit(first), F.year(F.current_date() if as_of is None else as_of) + 1))
