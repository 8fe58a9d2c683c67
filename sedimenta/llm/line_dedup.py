"""Line deduplication across documents, in DataFrame operations alone.

Line hashes are range-partitioned by (hash, document) and sorted there by
document and position, so that the occurrences of a line stream past in order
and the first of each document is marked; a line found in a very large share
of all documents simply spans several ranges. Every range reduces a hash to
one partial count, so the counting shuffle carries a row per hash and range at
most. The result is a keep bitmap for each text that lost lines, compressed to
the runs of its zeros; texts are not shuffled until the bitmaps are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import ascii_lower, is_small, join_hot, stage

#: Characters stripped from both ends of a line for its key: the fixed set of ASCII white space.
STRIP = " \t\n\x0b\f\r"


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Compressed keep bitmaps: ``(doc_key, text_key, runs array<struct<start int, length int>>)``.

    ``runs`` are the runs of zeros, in order: lines (from 0) to drop; all other
    bits are ones, and texts that keep every line have no row. A text is named
    by its id and ``text_key``, its xxhash64, so rows that share an id but not
    their text have bitmaps of their own. A key of at least ``min_chars`` code
    points found in at least ``min_docs`` documents (ids) keeps its lines only
    in the largest document id that has it.

    Null and empty texts are one empty line and never drop it. Rows without an
    id take no part. Rows that repeat an id count as one document; rows that
    repeat an id and its text share one bitmap. Long texts are taken whole, an
    empty table gives no rows, other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), F.split(text_col, "\n").alias("lines"))
    lines = (
        texts.select("doc", "text_key", F.posexplode("lines").alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc", "text_key", "pos", F.trim(F.col("line"), F.lit(STRIP)).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("doc", "text_key", "pos", ascii_lower(F.col("line")).alias("key"))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_key", "pos")
    )
    seen = stage(lines, "line-hashes")  # 36 bytes a line; ranges are sampled from it without splitting texts again
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = seen.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "text_key", "pos")
    of_document = Window.partitionBy("h1", "h2", "doc").orderBy("text_key", "pos")  # ranges and order are as it needs them
    seen = stage(ordered.withColumn("first", F.row_number().over(of_document) == 1), "line-occurrences")
    common = seen.groupBy("h1", "h2").agg(F.count_if("first").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    common = stage(common.select(F.struct("h1", "h2").alias("hash"), "rows", "keeper"), "line-common")
    named = seen.select(F.struct("h1", "h2").alias("hash"), "doc", "text_key", "pos")
    found = named.join(F.broadcast(common), "hash") if is_small(common, 64) else join_hot(named, common, "hash", "rows")
    lost = found.where(F.col("doc") < F.col("keeper")).select("doc", "text_key", "pos").distinct()
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc", "text_key").orderBy("pos"))
    runs = lost.withColumn("run", run).groupBy("doc", "text_key", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    return runs.groupBy(F.col("doc").alias("doc_key"), "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The elements of ``lines`` outside ``runs`` (null: all); both should be plain columns, as they are read for each line."""
    zeros = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    ones = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), zeros)
    return F.when(runs.isNull(), lines).otherwise(F.transform(ones, lambda i: F.get(lines, i)))


def with_runs(docs: DataFrame, id_col: str, text_col: str, **bounds) -> DataFrame:
    """``row`` (the columns of ``docs`` but its text), ``lines`` (null for a null text) and ``runs`` of each row."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **bounds)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    split = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text"), F.split(text_col, "\n").alias("lines"))
    joined = split.join(bitmaps, (F.col("doc") == F.col("doc_key")) & (F.col("text") == F.col("text_key")), "left")
    return joined.select("row", "lines", "runs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``docs`` with the repeated lines of ``text_col`` dropped; all columns stay.

    A null text stays null. A document may end up with an empty text. Rows
    without an id stay as they are.
    """
    marked = with_runs(docs, id_col, text_col, **bounds)
    text = F.array_join(kept_lines(F.col("lines"), F.col("runs")), "\n")
    return marked.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each row.

    Null and empty texts are one empty line. Rows that repeat an id and its
    text have equal results; rows without an id drop nothing. An empty table
    gives an empty one, extra columns are left out.
    """
    marked = with_runs(docs.select("doc_id", "text"), "doc_id", "text")
    kept = F.coalesce(F.array_join(kept_lines(F.col("lines"), F.col("runs")), "\n"), F.lit(""))
    dropped = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<start:int,length:int>>")), F.lit(0), lambda n, r: n + r["length"])
    return marked.select(
        "row.doc_id",
        F.coalesce(F.size("lines"), F.lit(1)).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
