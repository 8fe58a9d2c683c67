"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words and cut into windows; the automaton's
alphabet is the benchmark's vocabulary, so its size follows the benchmark and
not the characters in it. Each document is normalised and scanned once; word
positions of hits map back to code point offsets of the original text.

Executors cut the benchmark into pieces of at most ``PIECE_WORDS`` words, which
overlap so that no window is lost, and build the automaton from a broadcast
block of at most ``BLOCK_WORDS`` words (of at most ``WORD_BYTES`` bytes each,
as longer words go by their digest). A larger benchmark is scanned block by
block, so memory is bounded whatever its size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches, small_side, stage

#: Fixed values of the normal form: separators are ASCII characters other than digits and letters; A-Z count as a-z.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
BLOCK_WORDS = 200_000
PIECE_WORDS = 1_000
WORD = re.compile(rb"[^\x20]+")
#: Pieces of items: an id and normalised words each.
Block = list[tuple[str, list[bytes]]]
#: Longer words go by a digest of two bytes that no word has and 32 hex digits.
WORD_BYTES = 64


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def windows_of(words: list, size: int) -> Iterator[list]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield words[i : i + size]


def short(word: bytes) -> bytes:
    return word if len(word) <= WORD_BYTES else b"\0\0" + xxhash.xxh3_128_hexdigest(word).encode()


def short_words(words: list[bytes]) -> list[bytes]:
    return words if max(map(len, words), default=0) <= WORD_BYTES else [short(w) for w in words]


class Scanner:
    """Pieces of items ``(item, words)`` -> automaton over word numbers; 0 stands for words that no item has."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], size: int):
        self.vocab: dict[bytes, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for item, words in pieces:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            for w in windows_of(ids, size):
                key = tuple(w)
                known = self.auto.get(key, None)
                if known is None:
                    self.auto.add_word(key, (len(key), {item}))
                else:
                    known[1].add(item)
        self.empty = not self.vocab
        if not self.empty:
            self.auto.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [first, last + 1) word ranges and the items found."""
        if self.empty or not words:
            return [], set()
        get = self.vocab.get
        ids = tuple([get(w, 0) for w in short_words(words)])
        ranges: list[list[int]] = []
        items: set[str] = set()
        for last, (n, found) in self.auto.iter(ids):
            first = last - n + 1
            while ranges and ranges[-1][1] >= first:  # ends come in order, starts may not
                first = min(first, ranges.pop()[0])
            ranges.append([first, last + 1])
            items |= found
        return ranges, items


_scanners: dict[str, Scanner] = {}


def scanner(block: Broadcast, name: str, size: int) -> Scanner:
    """The scanner of a block; the last one built in this worker is kept for its next task."""
    if name not in _scanners:
        _scanners.clear()
        _scanners[name] = Scanner(block.value, size)
    return _scanners[name]


def spans_of(text: str, ranges: list[list[int]]) -> list[dict[str, int]]:
    """Code point spans of word ranges, in order, in the original text; one pass over it."""
    data = text.encode("utf-8", "surrogatepass")
    wanted = iter(sorted({x for a, b in ranges for x in (a, b - 1)}))
    at, points, byte, places = next(wanted, None), 0, 0, {}
    for k, m in enumerate(WORD.finditer(data.translate(TABLE))):
        if k == at:
            start = points + len(data[byte : m.start()].decode("utf-8", "surrogatepass"))
            points = start + len(data[m.start() : m.end()].decode("utf-8", "surrogatepass"))
            byte, places[k] = m.end(), (start, points)
            at = next(wanted, None)
            if at is None:
                break
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


FOUND = "doc_id long, text_key long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, ranges array<struct<a:int,b:int>>"
FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
])


def scan(docs: DataFrame, block: Block, size: int, only_hits: bool = False, spans: bool = True, ranges: bool = False) -> DataFrame:
    """One row per document (or only those with hits) of ``doc_id, text_key, text``; what is not asked for is null."""
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches):
        found = scanner(shared, name, size)
        for batch in batches:
            rows = []
            for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = words_of(text)
                hit, names = found.hits(words)
                if hit or not only_hits:
                    rows.append({
                        "doc_id": doc, "text_key": key, "n_words": len(words), "n_hit": sum(b - a for a, b in hit), "items": sorted(names),
                        "spans": (spans_of(text, hit) if hit else []) if spans else None, "ranges": [{"a": a, "b": b} for a, b in hit] if ranges else None,
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=FOUND_ARROW)

    return docs.mapInArrow(run, FOUND)


def benchmark_pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """``(item, words array<binary>)``: items cut into pieces that overlap by ``size`` - 1 words; items without words have none."""

    def cut(batches):
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = short_words(words_of(text))
                step = max(1, PIECE_WORDS - size + 1)
                for at in range(0, max(len(words) - size + 1, min(1, len(words))), step):
                    items.append(item)
                    pieces.append(words[at : at + step + size - 1])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.list_(pa.binary()))], ["item", "words"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return named.mapInArrow(cut, "item string, words array<binary>")


def benchmark_blocks(benchmark: DataFrame, size: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's pieces in blocks of at most ``block_words`` words (one piece at least); the driver holds a block at a time."""
    block, n = [], 0
    for item, words in stage(benchmark_pieces(benchmark, size), "benchmark-pieces").toLocalIterator():
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((item, [bytes(w) for w in words]))
        n += len(words)
    yield block


#: Joins the sorted ranges of several blocks, with their spans, where they meet.
MERGE = """
aggregate(places, cast(array() AS array<struct<a:int,b:int,start:int,end:int>>), (s, r) -> if(
  coalesce(try_element_at(s, -1).b >= r.ranges.a, false),
  array_append(slice(s, 1, size(s) - 1), struct(try_element_at(s, -1).a AS a, greatest(try_element_at(s, -1).b, r.ranges.b) AS b,
    try_element_at(s, -1).start AS start, greatest(try_element_at(s, -1).end, r.spans.end) AS end)),
  array_append(s, struct(r.ranges.a AS a, r.ranges.b AS b, r.spans.start AS start, r.spans.end AS end))))
"""


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS, spans: bool = True) -> DataFrame:
    """Per document: ``doc_id, text_key, n_words, n_hit, items, spans``.

    An item's windows are its runs of ``size`` words; a shorter item is one
    window. A document word inside any occurrence of a window is hit;
    ``spans`` (unless they are not asked for) are the hit passages as code
    point offsets of the original text and ``items`` the sorted ids found (a
    null id reads ``null``). ``text_key`` is the text's xxhash64. Null and
    empty texts have no words, and items without words no windows. Repeated
    rows are scanned each; extra columns are left out. An empty ``docs`` gives
    no rows, an empty benchmark finds nothing. Item ids that repeat are one.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    blocks = benchmark_blocks(benchmark, size, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return scan(docs, first, size, spans=spans).drop("ranges")
    base = stage(scan(docs, first, size, spans=spans, ranges=True), "leaks")
    held = base.where("n_hit > 0")
    for block in (x for group in ([second], blocks) for x in group):
        held = held.unionByName(stage(scan(docs, block, size, only_hits=True, spans=spans, ranges=True), "leaks"))
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("ranges", "spans")))))
    merged = held.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), places.alias("places"))
    merged = merged.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "items", F.expr(MERGE).alias("places"))
    n_hit = F.aggregate("places", F.lit(0), lambda n, p: n + p["b"] - p["a"])
    merged = merged.select("d", "k", "items", (F.transform("places", lambda p: F.struct(p["start"], p["end"])) if spans else F.lit(None)).alias("spans"), n_hit.cast("long").alias("n_hit"))
    both = base.select("doc_id", "text_key", "n_words").join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>") if spans else F.lit(None)
    return both.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"),
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each row; nulls, empty and repeated rows and empty tables as in ``find_contamination``."""
    found = find_contamination(docs, benchmark, spans=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the documents that share a window with the benchmark; all columns stay.

    A row goes by its own text, whatever other rows have its id. Rows without
    an id stay, as no decision can name them; so do null and empty texts, and
    all rows if the benchmark is empty.
    """
    bad = find_contamination(docs, benchmark, size, spans=False).where((F.col("n_hit") > 0) & F.col("doc_id").isNotNull())
    bad = small_side(stage(bad.select(F.col("doc_id").alias("bad"), "text_key").distinct(), "contaminated"), width=32)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text"))
    return rows.join(bad, (F.col("doc") == F.col("bad")) & (F.col("text") == F.col("text_key")), "left_anti").select("row.*")
