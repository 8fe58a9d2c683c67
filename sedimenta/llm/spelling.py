"""Spelling variant grouping with a trie of letter-group counts.

A word is arranged by how many of its letters fall into each of ``GROUPS``
groups: the trie's levels are successive groups, an edge is a count, and a leaf
holds the words with one vector of counts. One inserted, deleted or replaced
letter raises at most one count by one and lowers at most one by one, so a
depth-first search may spend one surplus and one deficit on its way down and
misses no near word; the words of the leaves it reaches are verified letter by
letter.

The trie is spread over the cluster. Its upper levels are keys of a shuffle:
each word is stored under its first counts and searched for under all keys that
the budget reaches. How many levels that takes follows from the words, so that
no key stores more than ``SHARD`` of them; words that all levels together leave
in one leaf are dealt out in blocks. Each task builds the lower levels of its
part and returns one row for each word searched, so no pairs are emitted.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches, small_side, stage

#: Letter groups, by code point modulo their number.
GROUPS = 16
#: Words that one part of the trie stores at most, on average over its blocks.
SHARD = 20_000
#: Distinct words that a task counts before it passes its counts on.
HELD = 200_000


def spoiled(doc: str, word: str, every: int) -> str:
    """``word`` without one letter if ``every`` divides the crc32 of ``doc:word``, which also says which one."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    return word[: h % len(word)] + word[h % len(word) + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, spoil: int | None = None) -> DataFrame:
    """``(word, n)``: words of at least ``min_chars`` letters and their occurrences, ``min_count`` at least, in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are
    lower-cased. Null and empty texts have none; rows that repeat an id or a
    text all count. With ``spoil``, one in so many words of a document loses a
    letter (``spoiled``; a null id counts as empty), which plants variants.
    """
    bounded_batches(docs.sparkSession)
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_chars)  # shorter runs give no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in Counter(runs.findall(text or "")).items():
                    word = word.encode("latin-1").lower().decode("latin-1")
                    if spoil:
                        word = spoiled("" if doc is None else doc, word, spoil)
                    if len(word) >= min_chars:
                        held[word] += n
            if len(held) >= HELD:
                yield table()
                held.clear()
        yield table()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def group_counts(word: str) -> list[int]:
    out = [0] * GROUPS
    for c in word:
        out[ord(c) % GROUPS] += 1
    return out


def vectors(words: DataFrame) -> DataFrame:
    """``(word, n, counts)``: each word with its letters by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([group_counts(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "n", "counts"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, counts array<int>")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if len(a) == len(b):
        return sum(map(operator.ne, a, b)) == 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    if len(b) - len(a) != 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


class Trie:
    """The lower levels: nested dicts of counts; a leaf is a list of ``(word, n)``."""

    def __init__(self, levels: list[int]):
        self.levels, self.root = levels, {} if levels else []

    def counts(self, word: str) -> list[int]:
        of = group_counts(word)
        return [of[g] for g in self.levels]

    def add(self, word: str, n: int) -> None:
        node, counts = self.root, self.counts(word)
        for k, c in enumerate(counts, 1):
            node = node.setdefault(c, {} if k < len(counts) else [])
        node.append((word, n))

    def leaves(self, word: str, surplus: int, deficit: int) -> list[list]:
        """The leaves that the budget reaches, depth first."""
        counts, out = self.counts(word), []

        def search(node, k: int, surplus: int, deficit: int) -> None:
            if k == len(counts):
                out.append(node)
                return
            c = counts[k]
            if (child := node.get(c)) is not None:
                search(child, k + 1, surplus, deficit)
            if surplus and (child := node.get(c + 1)) is not None:
                search(child, k + 1, 0, deficit)
            if deficit and (child := node.get(c - 1)) is not None:
                search(child, k + 1, surplus, 0)

        search(self.root, 0, surplus, deficit)
        return out


FOUND = "word string, n_near long, best_n long, best string"


def search_part(levels: list[int]):
    """Searches one part of the trie: rows ``stored`` build it, the others are looked up with the budget they have left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(levels)
        stored = pdf.stored.to_numpy()
        for word, n in zip(pdf.word[stored], pdf.n[stored]):
            trie.add(word, n)
        out = []
        asked = pdf[~stored]
        for word, surplus, deficit in zip(asked.word, asked.surplus, asked.deficit):
            near = [(-n, w) for leaf in trie.leaves(word, surplus, deficit) for w, n in leaf if one_edit(word, w)]
            if near:
                n, w = min(near)
                out.append((word, len(near), -n, w))
        return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    return run


def trie_depth(words: DataFrame, shard: int) -> int:
    """Upper levels at which no key stores more than ``shard`` words; all levels if none do."""
    keys = words.select(F.explode(F.sequence(F.lit(1), F.lit(GROUPS))).alias("depth"), "counts").groupBy("depth", F.slice("counts", 1, F.col("depth")).alias("key")).count()
    most = {r["depth"]: r["most"] for r in keys.groupBy("depth").agg(F.max("count").alias("most")).collect()}  # a row for each level
    return next((d for d in range(1, GROUPS) if most.get(d, 0) <= shard), GROUPS)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(word, n_near, best_n, best)`` of each word that has near words: their number, and the one of largest n (ties: smallest).

    ``words`` is ``(word, n)``, unique by word. A word is not near itself. An
    empty table gives an empty one.
    """
    held = stage(vectors(words), "spelling-words")
    spread = held.agg(*[F.coalesce(F.var_pop(F.col("counts")[g]), F.lit(0.0)).alias(str(g)) for g in range(GROUPS)]).first()
    order = sorted(range(GROUPS), key=lambda g: (-spread[g], g))  # groups that tell most come first
    held = held.withColumn("counts", F.array(*[F.col("counts")[g] for g in order]))
    depth = trie_depth(held, shard)
    keyed = held.select("word", "n", F.slice("counts", 1, depth).alias("part"))
    parts = stage(keyed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("blocks")), "spelling-parts")
    parts = small_side(parts.withColumnRenamed("part", "key"), 8 * GROUPS + 16)
    stored = keyed.join(parts, F.col("part") == F.col("key")).select("part", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), "word", "n", F.lit(True).alias("stored"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    moves = [(up, down) for up in range(-1, depth) for down in range(-1, depth) if up < 0 or up != down]  # -1: not spent above
    spent = F.array(*[F.struct(F.lit(u).alias("up"), F.lit(d).alias("down")) for u, d in moves])
    routes = keyed.withColumn("move", F.explode(spent)).where("move.down < 0 OR get(part, move.down) > 0")
    moved = F.expr("transform(part, (c, k) -> c + CASE WHEN k = move.up THEN 1 WHEN k = move.down THEN -1 ELSE 0 END)")
    routes = routes.select(moved.alias("part"), "word", "n", F.lit(False).alias("stored"), F.expr("int(move.up < 0)").alias("surplus"), F.expr("int(move.down < 0)").alias("deficit"))
    routes = routes.join(parts, F.col("part") == F.col("key")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = stored.unionByName(routes.select(*stored.columns))
    found = rows.groupBy("part", "block").applyInPandas(search_part(order[depth:]), FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the end of each chain of forms, which has no loops.

    Every join doubles how far a word sees, so a chain of k forms takes log2(k) of them.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-chains")
    while True:
        further = now.select(F.col("word").alias("w"), F.col("root").alias("far"))
        nxt = stage(now.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-chains")
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "root")
        now = nxt.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 5, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``words (word, n)``, unique by word.

    A word's form is its near word of largest n (ties: the smallest in code
    point order) if that n is at least ``ratio`` times the word's own, else
    null; its root is where following forms ends, the word itself if it has
    none. n grows along a chain, so chains end.
    """
    words = stage(words.select("word", "n"), "spelling-counts")
    near = near_words(words, shard).select(F.col("word").alias("w"), "n_near", "best_n", "best")
    told = words.join(near, F.col("word") == F.col("w"), "left").withColumn("takes", F.coalesce(F.col("best_n") >= F.col("n") * ratio, F.lit(False)))
    told = stage(told.select("word", F.when(F.col("takes"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = last_forms(told.where(F.col("form").isNotNull())).select(F.col("word").alias("w"), "root")
    return told.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, ratio: int = 5, **counting) -> DataFrame:
    """Spelling variants among the words of ``docs (doc_id, text)``; see ``word_counts`` and ``group_variants``. Extra columns are left out; an empty table gives no words."""
    return group_variants(word_counts(docs, **counting), ratio)


def digest(docs: DataFrame) -> DataFrame:
    """The production query: words of six letters and five occurrences, one in 199 words of a document spoiled, forms five times as frequent.

    Null texts have no words, null ids count as empty, ties go to the smallest
    word, repeated rows all count, an empty table gives no rows.
    """
    return variants(docs, ratio=5, min_chars=6, min_count=5, spoil=199)
