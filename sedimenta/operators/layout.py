"""Physical layout: compaction, clustering and file details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from ..sources import storage

#: Rows that quantiles are taken from, and bits of a rank. They shape files only, never rows.
QUANTILE_ROWS, RANK_BITS = 10_000, 8


def compact(df: DataFrame, keys: Sequence[str], files: int) -> DataFrame:
    """The same rows in ``files`` ranges of ``keys``, sorted, so that each file covers a narrow range."""
    return df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)


def quantiles(df: DataFrame, columns: Sequence[str], rows: int = QUANTILE_ROWS, bits: int = RANK_BITS) -> dict[str, list]:
    """For each column, at most ``2^bits - 1`` values that cut about ``rows`` sampled values into equal shares."""
    drawn = df.select(*[F.col(f"`{c}`") for c in columns]).orderBy(F.rand(17)).limit(rows).collect()  # each task passes on so many rows at most
    out = {}
    for i, c in enumerate(columns):
        values = sorted(r[i] for r in drawn if r[i] is not None)
        cuts = [values[k * len(values) >> bits] for k in range(1, 1 << bits)] if values else []
        out[c] = sorted(set(cuts))
    return out


def quantile_rank(c: Column, cuts: list, bits: int = RANK_BITS) -> Column:
    """How many of the sorted ``cuts`` are not above ``c``, by binary search; null ranks lowest."""
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(x) for x in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= c, at + step).otherwise(at))


def z_value(ranks: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """The bits of several ranks in turn, highest first, as one number."""
    out, width = F.lit(0).cast("long"), len(ranks)
    for b in range(bits):
        for i, r in enumerate(ranks):
            bit = F.shiftright(r, b).bitwiseAND(F.lit(1)).cast("long")
            out = out.bitwiseOR(F.shiftleft(bit, b * width + width - 1 - i))
    return out


def cluster(df: DataFrame, columns: Sequence[str], files: int) -> DataFrame:
    """The same rows in ``files`` parts along a Z-order of quantile ranks, so that each file covers a narrow range of every column.

    Sorting (``compact``) makes files narrow in the first column alone. At most
    seven columns; nulls come first, ties lie where their other columns put them.
    """
    if not 1 <= len(columns) <= 7:
        raise ValueError("one to seven columns")
    z, cuts = f"{free_prefix(df.columns)}z", quantiles(df, columns)
    placed = df.withColumn(z, z_value([quantile_rank(F.col(f"`{c}`"), cuts[c]) for c in columns]))
    return placed.repartitionByRange(files, z).sortWithinPartitions(z).drop(z)


def files_for(df: DataFrame, where: Column, columns: Sequence[str]) -> DataFrame:
    """One row: files behind ``df``, and those whose ranges of ``columns`` leave room for ``where``, which reads ``<column>_low`` and ``<column>_high``."""
    ranges = [f(F.col(f"`{c}`")).alias(f"{c}_{name}") for c in columns for f, name in ((F.min, "low"), (F.max, "high"))]
    per = df.select("*", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(*ranges)
    return per.agg(F.count(F.lit(1)).alias("files"), F.count_if(where).alias("needed"))


def file_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each file behind ``df``, its ``low`` and ``high``: the least and greatest structs of ``keys``, nulls lowest.

    Spark sorts the rows of a task by file to find the least of structs or of
    texts. So rows are first brought down, by hash, to one for each file and
    value of all keys but the last, which should be a number or a date; memory
    follows how many these are, not the rows.
    """
    lead, last = [f"k{i}" for i in range(len(keys) - 1)], "last"
    named = df.select(F.col("_metadata.file_path").alias("file"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keys, [*lead, last])])
    per = named.groupBy("file", *lead).agg(F.min(last).alias("least"), F.max(last).alias("most"), F.count_if(F.col(last).isNull()).alias("nulls"))
    low, high = (F.struct(*lead, x.alias(last)) for x in (F.when(F.col("nulls") == 0, F.col("least")), F.col("most")))
    return per.groupBy("file").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def compact_small(table, target_bytes: int, max_share: float = 0.75) -> dict[str, int]:
    """Rewrites the small files of a table without buckets, and those alone, as files of about ``target_bytes``.

    Files below ``max_share`` of the target are small; they are packed into as
    many new ones as their bytes fill. All others stay as they are, named by
    the commit. One small file alone is left. Returns files and bytes
    rewritten, files written and files kept.
    """
    folders = {f: storage.file_sizes(table.spark, f"{table.path}/{f}") for f in table.commit()["folders"]}  # a single file is its own only child
    name = lambda folder, x: f"{folder}/{x}" if x else folder
    small = {name(f, x): n for f, held in folders.items() for x, n in held.items() if n < target_bytes * max_share}
    total = sum(map(len, folders.values()))
    if len(small) < 2:
        return {"rewritten": 0, "bytes": 0, "written": 0, "kept": total}
    kept = {f: [y for x in held if (y := name(f, x)) not in small] for f, held in folders.items()}
    touched = {f: files for f, files in kept.items() if len(files) < len(folders[f])}
    size = sum(small.values())
    parts = max(1, round(size / target_bytes))
    table.replace_files(touched, table.files(sorted(small)).repartition(parts))
    return {"rewritten": len(small), "bytes": size, "written": parts, "kept": total - len(small)}


def table_detail(df: DataFrame) -> DataFrame:
    """Rows and bytes of each file behind a frame that was read from files."""
    meta = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))


def table_summary(df: DataFrame) -> DataFrame:
    """One row: files that hold rows, their bytes, and rows."""
    return table_detail(df).agg(F.count(F.lit(1)).alias("num_files"), F.sum("bytes").alias("size_in_bytes"), F.sum("rows").alias("rows"))
