"""Quality classifier: gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled documents (``MAX_TRAIN``
rows, taken in hash order) and travel to the executors as flat arrays; every
document is then scored from statistics of its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from . import gbt
from .staging import bounded_batches

#: Labelled rows used for fitting at most.
MAX_TRAIN = 20_000

CLASSES = ("lower", "upper", "digit", "blank", "newline", "symbol", "mark", "bracket", "other", "lead", "tail")


def _class_of(c: int) -> int:
    ch = chr(c)
    if c >= 0x80:
        return CLASSES.index("tail" if c < 0xC0 else "lead")
    for name, found in (("lower", ch.islower()), ("upper", ch.isupper()), ("digit", ch.isdigit()), ("newline", ch == "\n"), ("blank", ch.isspace()), ("symbol", ch in "#*$%&|<>=@^~_+\\"), ("mark", ch in ".,;:!?"), ("bracket", ch in "()[]{}\"'`")):
        if found:
            return CLASSES.index(name)
    return CLASSES.index("other")


TABLE = np.array([_class_of(c) for c in range(256)], np.uint8)
N_FEATURES = 33


def statistics(text: str | None) -> list[float]:
    """Fixed-length statistics of one whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    by = np.bincount(TABLE[np.frombuffer(data, np.uint8)], minlength=len(CLASSES))
    words = data.split()
    nw = max(1, len(words))
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = data.split(b"\n")
    spelled = [x for x in lines if x.strip()]
    top = counts.most_common(3)
    low = Counter(w.lower().strip(b".,;:!?#*$%&|<>") for w in counts)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(spelled)),
        *(by / n),
        (by[CLASSES.index("upper")] + 1) / (by[CLASSES.index("lower")] + by[CLASSES.index("lead")] + 2),
        by[CLASSES.index("symbol")] / nw, by[CLASSES.index("mark")] / nw, data.count(b"!") / nw, data.count(b"|") / nw,
        float(lens.mean()), float(lens.std()), float(lens.max()),
        len(counts) / nw, len(low) / max(1, len(counts)), sum(map(eq, words, words[1:])) / nw,
        (top[0][1] if top else 0) / nw, sum(c for _, c in top) / nw, (pairs + 1) / nw,
        1 - len(set(spelled)) / max(1, len(spelled)), len(data) / max(1, len(spelled)),
        sum(1 for w in counts if w[-1:] in b"#*$%&|<>!" and len(w) > 1) / max(1, len(counts)),
        sum(1 for w in counts if len(w) == 1) / max(1, len(counts)), sum(1 for w in counts if w.isalpha()) / max(1, len(counts)),
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(-1, N_FEATURES)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame, label: str, out: Column, most: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``most`` labelled documents that are not held out.

    The bound holds for the label rows, which are broadcast. Ids that repeat in
    ``docs`` can give more rows; callers bound what they collect of them.
    """
    known = labels.select(F.col("doc_id").alias("doc"), F.col(label).alias("y"), out.alias("out")).where(F.col("doc").isNotNull() & F.col("y").isin(0, 1) & ~F.col("out"))
    picked = known.select("doc", "y").orderBy(F.xxhash64("doc"), "doc", "y").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("doc")).select("doc_id", "text", F.col("y").cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **trees) -> gbt.Forest:
    """Trees for ``labels.quality``; executors compute the statistics, the driver gets ``max_train`` rows of them at most."""
    bounded_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = train_rows(docs, labels, "quality", held_out(), max_train).mapInArrow(features, "doc_id long, y int, x array<double>").limit(max_train).toArrow()
    order = np.lexsort((rows.column("y").to_numpy(), rows.column("doc_id").to_numpy()))  # the same trees from any partitioning
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)[order]
    return gbt.fit(x, rows.column("y").to_numpy().astype(float)[order], **trees)


def scorer(forest: gbt.Forest):
    """A pandas UDF: text -> probability of label 1."""

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(forest.probability(matrix(part)))

    return score


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, repeated ones too.

    Null and empty texts are scored as empty ones, long texts as a whole.
    Without usable labels every score is 0.5. A null id is held out by no
    fold's rule (null) and scored like any other; scores at the threshold count
    as 1. An empty table gives an empty one, extra columns are left out.
    """
    score = scorer(fit(docs, labels))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` that score at least ``threshold``; all columns stay.

    Rows are judged each by its text, as in ``digest``: null and empty ones as
    empty, long ones whole, repeated ones alike, whatever their ids. Without
    usable labels every score is 0.5, so the default threshold keeps nothing.
    An empty table stays empty.
    """
    score = scorer(fit(docs, labels))
    rows = docs.select(F.struct("*").alias("row"), score(F.col("text")).alias("score"))
    return rows.where(F.col("score") >= threshold).select("row.*")
