"""Quality rules as a short-circuit cascade.

A rule names the statistic it reads and says when a text fails. On a sample,
each rule's cost (seconds for the statistics that it needs) and selectivity
(share of texts rejected) are estimated; rules then run in order of rejection
per cost, and the first one that fails ends a text's cascade. The order
changes what is computed, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches, hash_sample

#: Texts that costs and selectivities are estimated on at most, in hash order.
SAMPLE = 1_000
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if chr(c) not in SYMBOLS)
_BLANKS = b" \t\n\x0b\x0c\r"


class Stats:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")

    def __getattr__(self, name: str):
        value = getattr(type(self), f"find_{name}")(self)
        setattr(self, name, value)
        return value

    def find_words(self) -> list[bytes]:
        return self.data.split()

    def find_n_words(self) -> int:
        return len(self.words)

    def find_word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, _BLANKS)))

    def find_n_symbols(self) -> int:
        return len(self.data.translate(None, _NOT_SYMBOL))

    def find_lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(_BLANKS)]

    def find_n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def find_n_repeat_words(self) -> int:
        """Words inside a 5-word window that the text has at least twice."""
        n = len(self.words)
        if n < 6:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        code, base = ids[: n - 4], len(known)
        if base**5 < 2**63:
            for j in range(1, 5):
                code = code * base + ids[j : n - 4 + j]
        else:  # rank after each step, so that codes stay below n * base
            for j in range(1, 5):
                code = np.unique(code * base + ids[j : n - 4 + j], return_inverse=True)[1]
        _, at, times = np.unique(code, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[at] > 1)
        if not len(again):
            return 0
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 5, -1)
        return int((edge.cumsum()[:n] > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Stats], bool]


#: The production rules. The first and the last are the base rules of the query's contract.
RULES = (
    Rule("too_few_words", lambda s: s.n_words < 10),
    Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 20 * s.n_words),
    Rule("symbols", lambda s: 4 * s.n_symbols > s.n_words),
    Rule("duplicate_lines", lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 20 * s.n_words),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, text_col: str = "text") -> list[Rule]:
    """``rules`` by estimated rejections per second, best first; ties by name."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    s, began = Stats(text), time.perf_counter()
                    rejected[k] += bool(rule.fails(s))
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "cost": cost, "rejected": rejected, "n": [n] * len(rules)})

    keys = [text_col] if "doc_id" not in docs.columns else ["doc_id", text_col]  # copies of a text are apart by their ids
    picked = hash_sample(docs.select(*keys), sample, *keys).select(text_col)
    found = picked.mapInArrow(measure, "rule long, cost double, rejected long, n long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    rate = {r["rule"]: (r["rejected"] / max(1, r["n"])) / max(1e-9, r["cost"] / max(1, r["n"])) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), rules[k].name))]


def first_failure(stats: Stats, ordered: list[Rule]) -> str | None:
    for rule in ordered:
        if rule.fails(stats):
            return rule.name
    return None


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base statistics of every document and the cascade's verdict.

    Null and empty texts have no words and fail; long texts are read whole.
    Rows that repeat an id or a text have a row each, a null id stays null. An
    empty table gives an empty one, extra columns are left out. Rules that tie
    in their estimates are asked in the order of their names; the order never
    changes a verdict.
    """
    bounded_batches(docs.sparkSession)
    ordered = order_rules(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in RESULT_ARROW]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Stats(text)
                passed = first_failure(s, ordered) is None  # the statistics below are what it has not asked for yet
                failed = s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words
                for col, v in zip(cols, (doc, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, passed and not failed)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RESULT_ARROW)], schema=RESULT_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` that pass every rule, with all columns; the cascade stops at a text's first failure.

    Null and empty texts fail. Each row is judged by its own text, so repeated
    rows stay or go together, null ids play no part, and an empty table stays
    empty. Ties of rules are as in ``digest``.
    """
    bounded_batches(docs.sparkSession)
    ordered = order_rules(docs, rules, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([first_failure(Stats(x), ordered) is None for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
