"""Removal of repeated word sequences by level-wise doubling.

A window of ``size`` words can only repeat if every shorter window in it does.
So short windows are counted first, and those repeated at one length alone are
extended to twice that length: 9, 18, 35 words for a size of 35. Levels end as
soon as no candidate survives.

Not every short window is needed. Of the shortest ones inside a window of
``size`` words, the one of smallest hash (its anchor) stands for it, and equal
windows have equal anchors at the same place; one position in thirteen is an
anchor at size 35. An anchor is extended to the left or to the right, as the
window around it has room. Consecutive windows that share all shorter ones are
a run, and are first compared as one span, the next doubling: where a span
repeats, all its windows do. Only runs that share their half window with
runs of other texts are taken apart into windows, one of each kind.

Each level is one scan of the texts in which hashes are made, joined with what
the level before has left, and counted with partial aggregates. The shorter
levels go by 64 bits, where a false candidate costs only work; spans and windows
go by 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import BROADCAST_BYTES, bounded_batches, join_hot, mix, small_side, stage

#: The shortest windows have at most so many words.
SHORTEST = 9
#: Odd multipliers of the two hashes, and what tells the second from the first.
BASES, OTHER = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0x165667B19E3779F9)


def lengths(size: int) -> list[int]:
    """``size`` halved, rounded up, until it is ``SHORTEST`` at most; shortest first."""
    out = [size]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def levels(size: int) -> int:
    """How many lengths are counted on the way to ``size``: all shorter ones, or the only one."""
    return max(1, len(lengths(size)) - 1)


#: Bytes whose hashes are made at a time, which bounds the memory of a very long text.
SLICE = 1 << 18
#: What a byte adds to its word's hash, by a fixed rule; bytes of white space add nothing.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * OTHER)
VALUES[[9, 10, 11, 12, 13, 32]] = 0
INSIDE = VALUES != 0
#: Characters of the texts that are hashed together: each step's fixed cost is shared by them, and its arrays fit a core's cache.
GROUP = 1 << 17


@lru_cache(maxsize=64)
def powers(base: np.uint64, most: int) -> np.ndarray:
    """``base`` to the power of 0 to ``most``, modulo 2^64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(most, base, np.uint64)], dtype=np.uint64)


@lru_cache(maxsize=4)
def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts: its bytes' values by powers of a base, summed without a loop over words."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = INSIDE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE)))
        cells = VALUES[b[starts[lo] : ends[hi - 1]]]
        most = 1 << max(10, len(cells).bit_length())
        cells *= powers(BASES[0], most)[: len(cells)]
        sums = running(cells)
        at = starts[lo:hi] - starts[lo]
        out[lo:hi] = (sums[ends[lo:hi] - starts[lo]] - sums[at]) * powers(inverse(BASES[0]), most)[at]
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64)), starts


def running(cells: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... ``cells``."""
    out = np.zeros(len(cells) + 1, np.uint64)
    np.cumsum(cells, out=out[1:])
    return out


def groups(bodies: list[str | None]) -> Iterator[slice]:
    """Parts of the list of about ``GROUP`` characters, a text at least."""
    lo = size = 0
    for hi, body in enumerate(bodies, 1):
        size += len(body or "")
        if size >= GROUP or hi == len(bodies):
            yield slice(lo, hi)
            lo, size = hi, 0


class Texts:
    """Hashes of any word range of some texts, whose words are numbered through; text ``k`` has those from ``first[k]`` up to ``first[k + 1]``.

    A range's hash does not depend on where the range is, nor on the texts beside its own.
    """

    def __init__(self, bodies: list[str | None], lanes: int = 1):
        data = [(x or "").encode("utf-8", "surrogatepass") for x in bodies]
        h, starts = word_hashes(b" ".join(data))
        self.n = len(h)
        self.first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in data)]))
        self.owner = np.repeat(np.arange(len(data)), np.diff(self.first))
        most = 1 << max(10, self.n.bit_length())
        self.sums, self.back = [], []
        for base in BASES[:lanes]:
            self.sums.append(running((mix(h ^ OTHER) if self.sums else h) * powers(base, most)[: self.n]))
            self.back.append(powers(inverse(base), most))

    def range(self, start: np.ndarray, length: np.ndarray | int, lane: int = 0) -> np.ndarray:
        sums = self.sums[lane]
        return mix((sums[start + length] - sums[start]) * self.back[lane][start] + np.asarray(length).astype(np.uint64))


def first_smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Where in ``x`` the smallest of each ``width`` values that follow each other is, the first of equals; by doubling."""
    at, held = np.arange(len(x), dtype=np.int32), 1
    while held < width:
        step = min(held, width - held)
        later = x[step:] < x[:-step]
        x, at = np.where(later, x[step:], x[:-step]), np.where(later, at[step:], at[:-step])
        held += step
    return at.astype(np.int64)


class Runs:
    """The windows of ``size`` words of some texts, in runs that share all shorter windows up to ``level``, by ``start``.

    ``start`` and ``count`` tell a run's windows, ``place`` and ``hash`` its
    window at ``level``, and ``before`` is the hash of the one at the level below.
    """

    def __init__(self, text: Texts, size: int, level: int):
        steps = lengths(size)
        n, k = text.n - size + 1, steps[0]
        whole = np.flatnonzero(text.owner[: max(0, n)] == text.owner[size - 1 :])  # windows of one text
        if not len(whole):
            self.start = self.count = self.place = np.zeros(0, np.int64)
            self.hash = self.before = np.zeros(0, np.uint64)
            return
        grams = text.range(np.arange(text.n - k + 1), k)
        place = first_smallest(grams, size - k + 1)[whole]
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # windows of two texts have no place in common
        start, count, place = whole[new], np.diff(np.r_[new, len(whole)]), place[new]
        held, before = grams[place], np.zeros(len(start), np.uint64)
        for shorter, length in zip(steps, steps[1 : level + 1]):
            more = length - shorter
            left = np.clip(place - start - more + 1, 0, count)  # the first windows of a run have room on the left, the others on the right
            both, side = np.nonzero(np.stack((left > 0, left < count), axis=1))
            is_left = side == 0
            start, count = np.where(is_left, start[both], start[both] + left[both]), np.where(is_left, left[both], count[both] - left[both])
            place, before = np.where(is_left, place[both] - more, place[both]), held[both]
            held = mix(text.range(place, length) + is_left.astype(np.uint64)) ^ before
        self.start, self.count, self.place, self.hash, self.before = start, count, place, held, before

    def spans(self, text: Texts, size: int, lane: int) -> np.ndarray:
        """Hashes of the words that a run's windows cover, with the place of the half window in them."""
        return mix(text.range(self.start, self.count + size - 1, lane) + (self.place - self.start).astype(np.uint64)) if len(self.start) else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def short_windows(docs: DataFrame, size: int, level: int) -> DataFrame:
    """``(before, hash)``: the windows of each run at ``level``, and at the level before it (0 at the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, now = [], []
            bodies = b.column(0).to_pylist()
            for part in groups(bodies):
                r = Runs(Texts(bodies[part]), size, level)
                now.append(r.hash)
                before.append(r.before)
            if now:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(before)), _signed(np.concatenate(now))], ["before", "hash"])

    return docs.select("text").mapInArrow(run, "before long, hash long")


SPANS = "doc long, text_key long, half long, s1 long, s2 long, start int, n int"


def spans(docs: DataFrame, size: int) -> DataFrame:
    """Every run of windows: ``(doc, text_key, half, s1, s2, start, n)`` of rows ``(doc, text_key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            bodies = b.column(2).to_pylist()
            for part in groups(bodies):
                text = Texts(bodies[part], lanes=2)
                r = Runs(text, size, levels(size) - 1)
                owner = text.owner[r.start]
                for o, x in zip(out, (part.start + owner, r.hash, r.spans(text, size, 0), r.spans(text, size, 1), r.start - text.first[owner], r.count)):
                    o.append(x)
            if not bodies:
                continue
            row, half, s1, s2, start, n = map(np.concatenate, out)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), _signed(half), _signed(s1), _signed(s2), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "text_key", "half", "s1", "s2", "start", "n"])

    return docs.select("doc", "text_key", "text").mapInArrow(run, SPANS)


def windows(docs: DataFrame, size: int) -> DataFrame:
    """The windows of the runs asked for: ``(doc, text_key, w1, w2, at, alone)`` of rows ``(doc, text_key, text, runs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, runs = b.column(2).to_pylist(), b.column(3)
            start, n, alone = (runs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "alone"))
            row = np.repeat(np.arange(len(bodies)), runs.value_lengths().to_numpy())
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row, alone = np.repeat(row, n), np.repeat(alone, n)
            w1, w2 = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
            for part in groups(bodies):
                text, mine = Texts(bodies[part], lanes=2), slice(*np.searchsorted(row, (part.start, part.stop)))
                words = at[mine] + text.first[row[mine] - part.start]
                w1[mine], w2[mine] = text.range(words, size, 0), text.range(words, size, 1)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), _signed(w1), _signed(w2), pa.array(at.astype(np.int32)), pa.array(alone)], ["doc", "text_key", "w1", "w2", "at", "alone"])

    return docs.mapInArrow(run, "doc long, text_key long, w1 long, w2 long, at int, alone boolean")


def small_lists(df: DataFrame, column: str) -> DataFrame:
    """A staged ``df`` hinted for broadcast if its rows, and what ``column`` lists at 32 bytes each, are within the bound."""
    size = df.agg(F.sum(F.size(column) * 32 + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def repeated_ranges(docs: DataFrame, size: int = 35) -> DataFrame:
    """``(doc, text_key, ranges array<struct<start int, n int>>)``: the repeated windows of ``docs (doc_id, text)``.

    A range is ``n`` windows of ``size`` words that follow each other from word
    ``start`` on; each occurs elsewhere too, in the same text or another row.
    A text is named by its id (null: 0) and its xxhash64, texts without
    repeated windows have no row. Null and empty texts, and those of fewer
    words, have no windows. Rows that repeat a text repeat its windows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    kept = None
    for level in range(levels(size)):
        found = short_windows(docs, size, level)
        if kept is not None:
            found = found.join(small_side(kept), F.col("before") == F.col("known"))
        kept = stage(found.groupBy(F.col("hash").alias("known")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("known"), "repeats-short")
        if kept.isEmpty():
            return docs.sparkSession.createDataFrame([], "doc long, text_key long, ranges array<struct<start:int,n:int>>")
    runs = stage(spans(docs, size).join(small_side(kept), F.col("half") == F.col("known")).drop("known"), "repeats-runs")
    # One run of each kind stands for its equals; kinds that share a half window are compared window by window.
    kinds = runs.groupBy("half", "s1", "s2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "text_key", "start", "n")).alias("r"))
    kinds = stage(kinds.select("half", F.struct("half", "s1", "s2").alias("kind"), "times", "r"), "repeats-kinds")
    several = stage(kinds.groupBy("half").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "repeats-halves")
    split = join_hot(kinds, several, "half", "kinds").select("r.doc", "r.text_key", F.struct("r.start", "r.n", (F.col("times") == 1).alias("alone")).alias("run"))
    split = stage(split.groupBy("doc", "text_key").agg(F.collect_set("run").alias("runs")), "repeats-split")  # bounded by a text's windows
    asked = small_lists(split, "runs").withColumnsRenamed({"doc": "d", "text_key": "k"})
    one = docs.join(asked, (F.col("doc") == F.col("d")) & (F.col("text_key") == F.col("k"))).select("doc", "text_key", "text", "runs")
    cells = stage(windows(one, size), "repeats-windows")  # rows that repeat a text are never alone
    again = cells.groupBy(F.struct("w1", "w2").alias("window")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    alone = cells.where("alone").select(F.struct("w1", "w2").alias("window"), "doc", "text_key", F.col("at").alias("start"), F.lit(1).alias("n"))
    single = join_hot(alone, stage(again, "repeats-again"), "window", "times").select("doc", "text_key", "start", "n")
    whole = join_hot(runs.select(F.struct("half", "s1", "s2").alias("kind"), "doc", "text_key", "start", "n"), kinds.where("times > 1").select("kind", "times"), "kind", "times").select("doc", "text_key", "start", "n")
    return whole.unionByName(single).groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))


def cut_words(size: int):
    """A column function: the words of a text, how many its ranges cover, and the others joined by blanks."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, held in zip(texts, ranges):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            step = np.zeros(len(words) + 1, np.int64)
            for r in held if held is not None else ():
                step[r["start"]] += 1
                step[r["start"] + r["n"] + size - 1] -= 1
            covered = np.cumsum(step)[:-1] > 0
            kept = [w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return cut


def with_cuts(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` as ``row``, with ``cut``, the result of ``cut_words``."""
    ranges = small_lists(stage(repeated_ranges(docs, size), "repeats"), "ranges").withColumnsRenamed({"doc": "d", "text_key": "k"})
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    joined = rows.join(ranges, (F.col("doc") == F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select("row", cut_words(size)("text", "ranges").alias("cut"))


def drop_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """``docs`` with every word that a repeated window of ``size`` words covers removed; all columns stay.

    Words are runs of characters other than 0x20 and 0x09-0x0D. A text that
    loses words has the others joined by one blank, any other stays as it is;
    null stays null. All occurrences go, the first too: windows are judged on
    the input, not on what is left. Ids may be null or repeat.
    """
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(F.col("row.text"))
    return with_cuts(docs, size).select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row, at 35 words.

    A null or empty text has no words, repeated rows are removed whole if they
    have 35 words, an empty table gives no rows, extra columns are left out.
    """
    marked = with_cuts(docs.select("doc_id", "text"), 35)
    return marked.select("row.doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))
