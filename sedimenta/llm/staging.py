"""Shared helpers: staged tables, checked broadcasts and word hashing.

Staged tables are Parquet folders under ``spark.checkpoint.dir``, the one
folder that the driver and all executors share. They cut lineage: a lost
executor costs a re-read, not a recomputation. Each application has its own
subfolder, which is removed when its driver ends.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch

#: Rows in an Arrow batch sent to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 512
#: A side of at most this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, which goes when the driver ends."""
    return scratch(spark, label)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has set a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def is_small(df: DataFrame, width: int) -> bool:
    """Whether the counted rows of ``df``, of ``width`` bytes each at most, may be broadcast; it must be cheap to count (staged, narrow)."""
    return df.count() * width <= BROADCAST_BYTES


def small_side(df: DataFrame, width: int = 16) -> DataFrame:
    """``df`` hinted for broadcast if it is small. Else no hint is given and Spark shuffles both sides."""
    return F.broadcast(df) if is_small(df, width) else df


#: A key is hot if it has more than one part in HOT of all rows, and more than HOT_ROWS: fewer are no load for a task.
HOT, HOT_ROWS = 1_000, 300


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, where ``key`` is unique and ``rows`` is how many rows of ``left`` have it.

    Hot keys, of which there are fewer than ``HOT``, are broadcast, so their
    rows stay where they are; the others are joined by a shuffle in which no
    key is hot. Both sides are read twice and should be staged; ``right`` should
    be of narrow columns. Rows whose key is null or unknown are left out.
    ``total`` is the sum of ``rows``.
    """
    total = total or right.agg(F.sum(rows)).first()[0] or 0
    hot = (F.col(rows) * HOT > total) & (F.col(rows) > HOT_ROWS)
    keys = [r[0] for r in right.where(hot).select(key).collect()]  # fewer than HOT
    if not keys:
        return left.join(right, key)
    kind = left.schema[key].dataType
    values = [(F.struct(*map(F.lit, k)) if isinstance(k, Row) else F.lit(k)).cast(kind) for k in keys]
    by_shuffle = left.where(~F.col(key).isin(*values)).join(right.where(~hot), key)
    return left.join(F.broadcast(right.where(hot)), key).unionByName(by_shuffle)


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About the ``rows`` rows of ``df`` whose ``columns`` hash smallest; ties stay together.

    Only hashes are ranked, so no texts are shuffled to draw the sample.
    """
    h = F.xxhash64(*columns)
    cut = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(cut)) if cut is not None else df.limit(0)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII text takes the faster built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


_MUL = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> _SHIFT)) * _MUL
    return x ^ (x >> _SHIFT)


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(data: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A
    text of fewer than ``size`` words has its whole sequence as one shingle;
    one without words has the empty set.
    """
    words = data.lower().split()
    n = len(words)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n == 0:
        return h
    k = min(size, n)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = mix(out) * np.uint64(31) + h[j : n - k + 1 + j]
    return np.unique(mix(out + np.uint64(k)))
