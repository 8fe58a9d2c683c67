"""Bronze to Silver: cleaning, gating, latest rows, and the two merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import allowed, clean_string, parse_duration, parse_long_date, row_hash, try_int, year_in_range
from ..operators.bronze import ensure_columns
from ..operators.cdc import latest_per_key
from ..operators.quality import quality_gate
from ..sources import storage
from ..sources.tables import Table

#: The columns that title batches may have, with the types of those that a batch may lack.
KNOWN = {c: "string" for c in "show_id type title director cast country date_added release_year rating duration listed_in description content_language _batch_id".split()} | {"_ingestion_sequence": "bigint", "_source_system": "string", "_source_file": "string", "_ingested_at": "timestamp"}
#: The columns whose record hash tells changes, in the order that they are hashed, and what ranks the rows of a key.
BUSINESS = "show_id content_type title director cast country date_added release_year rating duration_raw duration_value duration_unit genres description content_language".split()
ORDER = ("_ingested_at", "_ingestion_sequence", "_batch_id")


def clean_titles(bronze: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """Typed, trimmed and renamed title columns with a record hash, in one projection."""
    df = ensure_columns(bronze, KNOWN)
    raw, value, unit = parse_duration("duration")
    lineage = [c for c in KNOWN if c.startswith("_")]
    texts = {c: clean_string(c) for c in ("show_id", "title", "director", "cast", "country", "rating", "description", "content_language")}
    texts |= {"content_type": clean_string("type"), "genres": clean_string("listed_in"), "duration_raw": raw}
    cells = texts | {"date_added": parse_long_date("date_added"), "release_year": try_int("release_year"), "duration_value": value, "duration_unit": unit}
    out = df.select(*[c.alias(n) for n, c in cells.items()], *lineage, (F.current_timestamp() if run_ts is None else run_ts).alias("silver_updated_at"))
    return out.withColumn("_record_hash", row_hash(BUSINESS))


def title_rules(as_of: Column | None = None) -> list[tuple[str, Column]]:
    """The rules' messages and what they allow."""
    return [
        ("show_id is null or empty", F.col("show_id").isNotNull()),
        ("title is null or empty", F.col("title").isNotNull()),
        ("content_type is not Movie or TV Show", allowed("content_type", ["Movie", "TV Show"])),
        ("release_year is missing or outside accepted range", year_in_range("release_year", 1900, as_of)),
    ]


def title_report(as_of: Column | None = None) -> dict[str, Column]:
    """What counts as bad in the curated table."""
    return {
        "invalid_show_id": F.col("show_id").isNull() | (F.length(F.trim("show_id")) == 0),
        "invalid_title": F.col("title").isNull() | (F.length(F.trim("title")) == 0),
        "invalid_content_type": ~allowed("content_type", ["Movie", "TV Show"]),
        "invalid_release_year": ~year_in_range("release_year", 1900, as_of),
        "invalid_duration": F.col("duration_value").isNotNull() & (F.col("duration_value") <= 0),
    }


def prepare_updates(cleaned: DataFrame, rules: Sequence[tuple[str, Column]], keys: Sequence[str], order: Sequence[str] = ORDER, run_ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The latest valid row of each key with ``_prepared_at``, and all rejected rows."""
    valid, rejected = quality_gate(cleaned, rules, run_ts)
    ts = F.current_timestamp() if run_ts is None else run_ts
    return latest_per_key(valid, keys, order).withColumn("_prepared_at", ts), rejected


def publish_updates(bronze: DataFrame, updates: Table, quarantine: Table, run_ts: Column | None = None, as_of: Column | None = None) -> None:
    """Rebuilds the staged updates, and the quarantine of this run alone; Bronze is read and cleaned once for both."""
    prepared, rejected = prepare_updates(storage.staged(clean_titles(bronze, run_ts), "cleaned"), title_rules(as_of), ["show_id"], run_ts=run_ts)
    quarantine.overwrite(rejected)
    updates.overwrite(prepared)
