"""Toxicity: noisy-channel deobfuscation, then a learned lexicon.

A word that may be written in disguise becomes a character lattice: leetspeak
signs may stand for letters, masked characters for any letter each (a run of
them also for one), repeated letters for one or two, and spaced letters may belong together. Viterbi decoding finds
the likeliest reading under a character 4-gram model counted over all
documents. The restored words are then looked up in a lexicon of words and word
beginnings that are far more frequent in toxic documents, and boosted trees
score a document from its hits: how many, how telling and how dense. Lexicon
and trees are fitted on a bounded sample of labelled documents, of which near
copies count once, as else whatever else they share would look toxic.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from . import gbt
from .quality import held_out, train_rows
from .staging import WordHashes, bounded_batches, mix, shingle_set, stage

#: Labelled rows used for fitting at most.
MAX_TRAIN = 20_000

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
#: Signs that may mask any letter, and signs that may part letters.
MASKS, PARTS = "*#", ".-_*~"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Runs of masks up to this length are read letter by letter; in longer ones, which no word is as long as, all stand for one letter.
MASKED = 24
#: Channel costs in nats: a sign read as a letter, a run of masks read as letters (and again for each that is none), a dropped sign, a shortened run, a pair made single, a word break put in.
SIGN, MASK, DROP, RUN, PAIR, BREAK = 1.0, 3.3, 4.0, 0.7, 2.5, 3.0
#: Characters whose n-grams are counted at a time.
CHUNK = 1 << 18
#: The model's alphabet: 0 a break, 1-26 a letter without its accents, 27 any other letter.
SIZE = 28


def _fold_table() -> np.ndarray:
    table = np.zeros(0x251, np.int32)
    table[0x250] = 27  # and for all beyond
    for c in range(0x250):
        if chr(c).isalpha():
            base = unicodedata.normalize("NFKD", chr(c).lower())[0]
            table[c] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


FOLD = _fold_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return FOLD[np.minimum(points, 0x250)]


def symbol(ch: str) -> int:
    c = ord(ch)
    return int(FOLD[c]) if c < 0x250 else 27 if ch.isalpha() else 0


def ngrams_of(texts: list[str]) -> np.ndarray:
    """4-gram counts of some texts, each between breaks of its own; blanks part them, so that all are counted at once."""
    s = symbols(f"   {'    '.join(x.lower() for x in texts)} ")
    last = s[2:-1]  # nothing before a break counts as context
    second = np.where(last > 0, s[1:-2], 0)
    third = np.where(second > 0, s[:-3], 0)
    out = np.bincount(((third * SIZE + second) * SIZE + last) * SIZE + s[3:], minlength=SIZE**4)
    out[0] -= 3 * (len(texts) - 1)  # a break after a break, for each blank before a text but the first
    return out


def chunks(texts: list[str | None], most: int) -> Iterator[list[str]]:
    """The texts that are not empty, in lists of about ``most`` characters."""
    held, size = [], 0
    for text in texts:
        if text:
            held.append(text)
            size += len(text)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_ngrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character 4-gram counts over all documents: at most 28^4 numbers, whatever the corpus."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**4, np.int64)
        for b in batches:
            for texts in chunks(b.column(0).to_pylist(), CHUNK):
                total += ngrams_of(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    found = docs.select(text_col).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**4)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def char_model(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log-probabilities of a symbol after three others, backing off to fewer."""
    n4 = counts.reshape((SIZE,) * 4)
    p = np.full(SIZE, 1 / SIZE)
    for n in (n4.sum(axis=(0, 1, 2)), n4.sum(axis=(0, 1)), n4.sum(axis=0), n4):
        p = (n + weight * p) / (n.sum(axis=-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32)


class Wide:
    """Many states as arrays: keys in order, scores, and for each the state it came from and what was read (of ``out``, one text or a letter for each)."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray, sources: list, source: np.ndarray | None, parent: np.ndarray, out: str):
        self.keys, self.scores, self.sources, self.source, self.parent, self.out = keys, scores, sources, source, parent, out

    @classmethod
    def of(cls, states: dict | Wide) -> Wide:
        if isinstance(states, cls):
            return states
        keys = sorted(states)
        return cls(np.array(keys, np.int64), np.array([states[k][0] for k in keys]), [[states[k][1] for k in keys]], None, np.arange(len(keys)), "")

    def linked(self, i: int) -> tuple:
        return self, i

    def back(self, i: int) -> tuple[tuple | None, str]:
        """The linked pairs before state ``i``, and what it added."""
        source, parent = self.sources[0 if self.source is None else self.source[i]], self.parent[i]
        out = self.out[i % len(LETTERS)] if self.out == LETTERS else self.out
        return (source.linked(parent) if isinstance(source, Wide) else source[parent]), out


def joined(parts: list[tuple[dict | Wide, float]]) -> dict | Wide:
    """The best of several states, each at a cost."""
    if not any(isinstance(x, Wide) for x, _ in parts):
        new: dict = {}
        for part, cost in parts:
            for k, (s, text) in part.items():
                if k not in new or new[k][0] < s - cost:
                    new[k] = (s - cost, text)
        return new
    sources = [Wide.of(x) for x, _ in parts]
    best, source, parent = np.full(SIZE**3, -np.inf), np.zeros(SIZE**3, np.int64), np.zeros(SIZE**3, np.int64)
    for j, (x, (_, cost)) in enumerate(zip(sources, parts)):
        won = np.flatnonzero(x.scores - cost > best[x.keys])
        k = x.keys[won]
        best[k], source[k], parent[k] = x.scores[won] - cost, j, won
    k = np.flatnonzero(best > -np.inf)
    return Wide(k, best[k], sources, source[k], parent[k], "")


def spelled(states: Wide, i: int) -> str:
    """All that was read on the way to state ``i``."""
    text, parts = states.linked(i), []
    while text:
        text, out = text[0].back(text[1]) if isinstance(text[0], Wide) else text
        parts.append(out)
    return "".join(reversed(parts))


class Decoder:
    """Viterbi decoding of one disguised word or run of spaced letters; tokens read before are remembered up to a bound.

    No history is pruned: the last three symbols are all that a state has, so there are at most 28^3.
    """

    LIMIT = 200_000
    #: Steps of more transitions than this are done on arrays.
    FEW = 800

    def __init__(self, model: np.ndarray):
        self.flat = model.reshape(-1).tolist()
        self.table = np.array(self.flat)
        self.known: dict[str, tuple[str, ...]] = {}
        self.runs: dict[str, list[str]] = {}
        self.tails: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def readings(self, token: str) -> tuple[str, ...]:
        """A lower-cased token's core as it stands (or ``''``), then the words that its forms are restored to if it is disguised."""
        plain = plain_word(token)
        if plain:
            return (plain,)  # most of a corpus' distinct tokens: not worth a place
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[token] = (core_of(token), *dict.fromkeys(w for form in forms(token) for w in self.decode(form).split()))
        return found

    def spaced(self, text: str) -> list[str]:
        """Words restored from a lower-cased text's runs of spaced letters."""
        out: list[str] = []
        for m in SPACED.finditer(text) if SPACED_END.search(text) else ():
            run = re.sub(r"(?<=[\w@$!|+€*])[ .\-_*~](?=[\w@$!|+€*])", "", m[0])
            if len(self.runs) >= 50_000:
                self.runs.clear()
            if run not in self.runs:
                self.runs[run] = self.decode(run, spaced=True).split() if len(set(run)) > 1 else []
            out += self.runs[run]
        return out

    def step(self, states: dict | Wide, options: list[tuple[str, float]]) -> dict | Wide:
        """States are the last three symbols, with their score and what was read as linked pairs; an option is what a sign is read as, and its cost."""
        if isinstance(states, Wide) or len(states) * len(options) > self.FEW:
            return self.wide_step(Wide.of(states), options)
        flat, new = self.flat, {}
        coded = [(out, cost, [symbol(ch) for ch in out]) for out, cost in options]
        for h, (score, text) in states.items():
            for out, cost, syms in coded:
                s, k = score - cost, h
                for sym in syms:
                    code = k * SIZE + sym
                    s += flat[code]
                    k = code % SIZE**3 if sym else 0
                if k not in new or new[k][0] < s:
                    new[k] = (s, (text, out))
        return new

    def wide_step(self, states: Wide, options: list[tuple[str, float]]) -> dict | Wide:
        """The same for many states."""
        parts = []
        for out, cost in options:
            s, k = states.scores - cost, states.keys
            for ch in out:
                sym = symbol(ch)
                code = k * SIZE + sym
                s = s + self.table[code]
                k = code % SIZE**3 if sym else np.zeros(len(s), np.int64)
            if out.endswith(" "):
                first = s.argmax(keepdims=True)  # all are one state
            else:
                order = np.lexsort((-s, k))
                first = order[np.r_[True, np.diff(k[order]) > 0]]
            parts.append((Wide(k[first], s[first], [states], None, first, out), 0.0))
        return joined(parts)

    def letters(self, states: dict | Wide, cost: float) -> dict | Wide:
        """A step in which any letter is read."""
        if isinstance(states, dict) and len(states) * len(LETTERS) <= self.FEW:
            return self.step(states, [(a, cost) for a in LETTERS])
        states = Wide.of(states)
        syms = np.array([symbol(a) for a in LETTERS])
        thirds, row = np.unique(states.keys // SIZE**2, return_inverse=True)
        lasts, column = np.unique(states.keys % SIZE**2, return_inverse=True)
        scores, at = np.full((len(thirds), len(lasts)), -np.inf), np.zeros((len(thirds), len(lasts)), np.int64)
        scores[row, column], at[row, column] = states.scores - cost, np.arange(len(row))
        tried = scores[:, :, None] + self.table[((thirds[:, None] * SIZE**2 + lasts) * SIZE)[:, :, None] + syms]
        won = tried.argmax(0)
        best = np.take_along_axis(tried, won[None], 0)[0]
        keys = lasts[:, None] * SIZE + syms
        return Wide(keys.ravel(), best.ravel(), [states], None, at[won, np.arange(len(lasts))[:, None]].ravel(), LETTERS)

    def masked(self, states: dict | Wide, n: int) -> dict | Wide:
        """A run of ``n`` masks: a letter each, one letter in all, or none."""
        one = many = self.letters(states, MASK)
        for _ in range(n - 1 if n <= MASKED else 0):
            many = self.letters(many, 0.0)
        parts = [(self.step(states, [(" ", DROP)]), 0.0), (one, MASK * (n - 1) if n <= MASKED else 0.0)]
        return joined(parts if one is many else [*parts, (many, 0.0)])

    def tail(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each history the score of its best ``n`` letters and the break that ends the word, and the first of those letters."""
        key = (LETTERS, n)
        if key not in self.tails:
            h, syms = np.arange(SIZE**3), np.array([symbol(a) for a in LETTERS])
            if n == 0:
                self.tails[key] = self.table[h * SIZE], h
            else:
                codes = h[:, None] * SIZE + syms
                tried = self.table[codes] + self.tail(n - 1)[0][codes % SIZE**3]
                first = tried.argmax(axis=1)
                self.tails[key] = tried[h, first], first
        return self.tails[key]

    def ended(self, states: dict | Wide, n: int) -> str:
        """What is read if a run of ``n`` masks ends the word: as ``masked`` and the closing break, with the letters looked up."""
        states = Wide.of(states)
        h = states.keys
        ways = [(0, states.scores - DROP + self.table[h * SIZE] + self.table[0]), (1, states.scores - MASK * (n if n <= MASKED else 1) + self.tail(1)[0][h])]
        if 1 < n <= MASKED:
            ways.append((n, states.scores - MASK + self.tail(n)[0][h]))
        best = max(range(len(ways)), key=lambda k: ways[k][1].max())
        letters, scores = ways[best]
        at = int(scores.argmax())
        k, read = int(h[at]), ""
        for left in range(letters, 0, -1):
            read += LETTERS[self.tail(left)[1][k]]
            k = (k * SIZE + symbol(read[-1])) % SIZE**3
        return (spelled(*states.linked(at)) + read).strip()

    def decode(self, raw: str, spaced: bool = False) -> str:
        states: dict[int, tuple[float, tuple | None]] | Wide = {0: (0.0, None)}
        i = 0
        while i < len(raw):
            ch, j = raw[i], i + 1
            while j < len(raw) and raw[j] == ch:
                j += 1
            n = j - i
            if ch.isalpha():
                options = [(ch * n, 0.0)] + [(ch * m, RUN if n > 2 else PAIR) for m in (1, 2) if m < n]
            elif ch in LEET:
                options = [(a * m, SIGN * n + (PAIR if m < n == 2 else 0.0)) for a in LEET[ch] for m in {1, min(n, 2)}] + [(" ", DROP)]
            elif ch not in MASKS:
                options = [("", 0.0 if ch in PARTS else DROP), (" ", 0.0)]
            if ch in MASKS and j == len(raw):
                return self.ended(states, n)
            states = self.masked(states, n) if ch in MASKS else self.step(states, options)
            if spaced and j < len(raw):
                states = self.step(states, [("", 0.0), (" ", BREAK)])
            i = j
        return spelled(*Wide.of(self.step(states, [(" ", 0.0)])).linked(0)).strip()


_decoders: dict[int, Decoder] = {}


def decoder_of(model: np.ndarray) -> Decoder:
    """The last decoder of this worker, with what it remembers, if it has the same model."""
    key = zlib.crc32(model.tobytes())
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(model)
    return _decoders[key]


#: Three or more single letters or signs with one separator between each two.
SPACED = re.compile(r"(?<!\S)[\w@$!|+€](?:[ .\-_*~][\w@$!|+€*]){2,}(?![^\s.,;:!?])")
#: The last three of them, as a faster test of whether a text has any.
SPACED_END = re.compile(r"[ .\-_*~][\w@$!|+€*][ .\-_*~][\w@$!|+€*](?![^\s.,;:!?])")
RUNS = re.compile(r"([^\W\d_])\1\1")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"


def core_of(token: str) -> str:
    return token.strip(EDGE)


#: Signs at a word's edges that can stand for no letter.
PEEL = "".join(c for c in EDGE if c not in LEET and c not in MASKS)


def plain_word(token: str) -> str:
    """A lower-cased token's core if no form of it can be a disguised word, as all are letters without runs; else ``''``."""
    core = token.strip(PEEL)
    return core if core.isalpha() and (len(core) - len(set(core)) < 2 or not RUNS.search(core)) else ""


def unplain(word: str) -> bool:
    return len(word) > 2 and any(c.isalpha() for c in word) and (not word.isalpha() or RUNS.search(word) is not None)


def peeled(token: str) -> str:
    """A token without the punctuation at its edges; brackets and closing ``!`` count as such, other signs of letters stay."""
    return token.lstrip("(" + PEEL).rstrip("(!" + PEEL)


def forms(token: str) -> tuple[str, ...]:
    """What of a lower-cased token may be a disguised word: peeled, with ``(`` and ``!`` kept as letters, and its bare core."""
    return tuple(dict.fromkeys(x for x in (peeled(token), token.strip(PEEL), core_of(token)) if unplain(x)))


def disguised(token: str) -> str:
    """The likeliest of a lower-cased token's forms: ``''`` if it reads as it stands."""
    form = peeled(token)
    return form if unplain(form) else ""


def features(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 8 letters."""
    return ["=" + word] + [word[:k] for k in range(3, min(9, len(word)))] if len(word) > 1 else []


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


class Lexicon:
    """Entries (``=word`` or a beginning) with the log of how much likelier they are in toxic documents."""

    def __init__(self, weight: dict[str, float] | None = None):
        self.weight = weight or {}
        self.loose = {squeezed(f[1:]): (f, w) for f, w in self.weight.items() if f[0] == "="}
        self.heads = {f.removeprefix("=")[:3] for f in self.weight}  # a plain word with another beginning has no entry

    def best(self, words: list[str], restored: list[str]) -> tuple[str, float] | None:
        """The most telling entry of these words; restored ones may differ in doubled letters."""
        get = self.weight.get
        found = [(get(f, 0.0), f) for w in (*words, *restored) for f in features(w)]
        found += [(x[1], x[0]) for w in restored if (x := self.loose.get(squeezed(w)))]
        found += [(get(w, 0.0), w) for w in restored if len(w) > 2]  # a beginning that lacks the second of two letters
        w, f = max(found, default=(0.0, ""))
        return (f, w) if w > 0 else None


#: The half-way point, in occurrences, of how far repetition in one document tells.
SATURATION = 3.0


def worth(n: int) -> float:
    """What ``n`` occurrences of an entry in one document count for: each further one less, as in BM25."""
    return n * (SATURATION + 1) / (n + SATURATION)


@lru_cache(maxsize=10_000)
def thousandths(n: int) -> int:
    return round(1000 * worth(n))


class Reader(dict):
    """Token -> the lexicon entry it is read as, or None; remembered up to a bound."""

    LIMIT = 200_000

    def __init__(self, model: np.ndarray, lexicon: Lexicon | None = None):
        super().__init__()
        self.decoder, self.lexicon = decoder_of(model), lexicon or Lexicon()

    def __missing__(self, token: str) -> tuple[str, float] | None:
        if len(self) >= self.LIMIT:
            self.clear()
        core = plain_word(token)
        if core:
            value = self.lexicon.best([core], []) if core[:3] in self.lexicon.heads else None
        else:
            core, *restored = self.decoder.readings(token)
            value = self.lexicon.best([core], restored)
        self[token] = value
        return value

    def words(self, text: str | None) -> Counter:
        """All plain words of a text as they stand, and those restored, with their counts."""
        text, out = (text or "").lower(), Counter()
        get = out.get
        for token, n in Counter(text.split()).items():
            plain = plain_word(token)
            for w in (plain,) if plain else set(self.decoder.readings(token)):
                if w:
                    out[w] = get(w, 0) + n
        out.update(self.decoder.spaced(text))
        return out

    def hits(self, text: str | None) -> list[float]:
        """What the trees see of one whole text."""
        text = (text or "").lower()
        tokens = text.split()
        found = [e for e in map(self.__getitem__, tokens) if e]
        found += [e for w in self.decoder.spaced(text) if (e := self.lexicon.best([], [w]))]
        n, by = max(1, len(tokens)), Counter(found)
        total = sum(worth(c) * w for (_, w), c in by.items())
        return [total, total / n, max((w for _, w in by), default=0.0), float(len(by)), float(len(found)), len(found) / n, np.log(n)]


N_HITS = 7


def restore(text: str, decoder: Decoder) -> str:
    """The text, lower-cased, with disguised words replaced by what they are read as; all else stays."""
    low = SPACED.sub(lambda m: decoder.decode(re.sub(r"[ .\-_*~]", "", m[0]), spaced=True), text.lower())

    def read(piece: str) -> str:
        form = disguised(piece)
        word = decoder.decode(form) if form else piece
        return piece if word == core_of(piece) else word

    return "".join(read(piece) if piece.strip() else piece for piece in re.split(r"(\s+)", low))


def distinct_rows(rows: DataFrame, most: int) -> set[int]:
    """Ids of the labelled rows with one of each group of near copies: those with a MinHash of three-word shingles in common."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            marks = []
            for text in b.column("text").to_pylist():
                s = shingle_set((text or "").encode("utf-8", "surrogatepass"), 3, hashes)
                marks.append([int(mix(s ^ np.uint64(seed)).min() >> np.uint64(1)) for seed in (1, 2, 3)] if len(s) else [0, 0, 0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "marks"])

    kept, seen = set(), set()
    got = rows.mapInArrow(smallest, "doc_id long, marks array<long>").limit(most).toArrow().to_pydict()
    for doc, marks in sorted(zip(got["doc_id"], got["marks"])):
        if not any(x in seen for x in enumerate(marks)):
            kept.add(doc)
        seen.update(enumerate(marks))
    return kept


def choose(names: list[str], pos: np.ndarray, neg: np.ndarray, docs: np.ndarray, n_pos: float, n_neg: float, tried: int) -> dict[str, float]:
    """Entries whose counts could hardly come about by chance, with their weights.

    ``pos`` and ``neg`` are occurrences in toxic and other documents (of
    ``n_pos`` and ``n_neg`` words), ``docs`` toxic documents. The likelihood
    ratio has to outweigh ``tried``, the number of candidates. The best go first; a
    beginning and a word that it begins are not both taken.
    """
    if not len(names) or not n_pos or not n_neg:
        return {}
    total, share = pos + neg, n_pos / (n_pos + n_neg)
    ratio = pos * np.log(np.maximum(pos, 1e-9) / (total * share)) + np.where(neg > 0, neg * np.log(np.maximum(neg, 1e-9) / (total * (1 - share))), 0)
    weight = np.log((pos + 0.5) / n_pos) - np.log((neg + 0.5) / n_neg)
    good = np.flatnonzero((ratio > np.log(tried) + 4) & (weight > np.log(5)) & (docs >= 3))
    taken: dict[str, float] = {}
    begins: set[str] = set()
    for k in sorted(good, key=lambda k: (-ratio[k], -len(names[k]), names[k])):
        plain = names[k].lstrip("=")
        if names[k] in begins or plain in begins and names[k][0] != "=" or any(plain[:j] in taken for j in range(3, len(plain) + 1)):
            continue
        taken[names[k]] = float(weight[k])
        begins.update(plain[:j] for j in range(3, len(plain)))
    return taken


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    forest: gbt.Forest = field(default_factory=lambda: gbt.fit(np.zeros((0, N_HITS)), np.zeros(0)))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_train: int = MAX_TRAIN) -> Model:
    """Lexicon and trees for ``labels.toxic`` from at most ``max_train`` labelled rows."""
    spark = docs.sparkSession
    rows = stage(train_rows(docs, labels, "toxic", held_out(parts=5, part=0), max_train), "toxic-train")
    shared = spark.sparkContext.broadcast(model)  # 28^4 numbers
    kept = spark.sparkContext.broadcast(distinct_rows(rows, max_train))  # at most max_train ids

    def counted(text: str | None, reader: Reader) -> dict[str, int]:
        n: dict[str, int] = {}
        get = n.get
        for w, c in reader.words(text).items():
            for f in features(w):
                n[f] = get(f, 0) + c
        return n

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, size = Reader(shared.value), [0, 0]
        seen: list[Counter] = [Counter(), Counter(), Counter()]  # thousandths in other and in toxic documents, toxic documents

        def out() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            cols = [pa.array([c[f] for f in names], pa.int64()) for c in seen]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *cols], ["f", "neg", "pos", "docs"])

        for b in batches:
            for doc, text, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))):
                if doc in kept.value:
                    size[y] += len((text or "").split())
                    mine = counted(text, reader)
                    sums, get = seen[y], seen[y].get
                    for f, c in mine.items():
                        sums[f] = get(f, 0) + thousandths(c)
                    if y:
                        seen[2].update(mine.keys())
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out()
        seen[0][""], seen[1][""] = size
        yield out()

    # All features of at most max_train texts are counted; what reaches the driver is what could hardly come about by chance.
    found = stage(rows.mapInArrow(counts, "f string, neg long, pos long, docs long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("neg", "pos", "docs"))).where("docs >= 3 OR f = ''"), "toxic-counts")
    sizes = found.where("f = ''").first()
    n_neg, n_pos = (float(sizes["neg"]), float(sizes["pos"])) if sizes else (0.0, 0.0)
    n_names = found.count() - 1
    telling = found.where(f"f != '' AND (pos + 500) * {n_neg} > (neg + 500) * {n_pos}").toArrow()
    neg, pos = (telling.column(c).to_numpy() / 1000 for c in ("neg", "pos"))
    lexicon = Lexicon(choose(telling.column("f").to_pylist(), pos, neg, telling.column("docs").to_numpy(), n_pos, n_neg, n_names))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array([reader.hits(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.mapInArrow(shown, "doc_id long, y int, x array<double>").limit(max_train).toArrow()
    y, ids = got.column("y").to_numpy().astype(float), got.column("doc_id").to_numpy()
    order = [k for k in np.lexsort((y, ids)) if ids[k] in kept.value]
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, N_HITS)[order]
    for b in (shared, kept):
        b.unpersist()
    return Model(lexicon, gbt.fit(x, y[order], trees=60, depth=3, rate=0.15))


def scorer(spark: SparkSession, model: np.ndarray, fitted: Model):
    """A pandas UDF: text -> probability of label 1. All that it carries is of bounded size."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value, fitted.lexicon)
        for part in texts:
            yield pd.Series(fitted.forest.probability(np.array([reader.hits(x) for x in part], float).reshape(-1, N_HITS)))

    return score


def restorer(spark: SparkSession, model: np.ndarray):
    """A pandas UDF: text -> lower-cased text with its disguised words restored."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("string")
    def restored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = decoder_of(shared.value)
        for part in texts:
            yield part.map(lambda x: restore(x, decoder) if x else x)

    return restored


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null and empty texts score as texts without a hit do, long ones are read
    whole; without usable labels every score is 0.5. Repeated rows have a row
    each, a null id is scored like any other and has no fold (null). Scores at
    the threshold count as 1; readings that tie are taken in a set order. An
    empty table gives an empty one, extra columns are left out.
    """
    docs = docs.select("doc_id", "text")
    model = char_model(count_ngrams(docs))
    score = scorer(docs.sparkSession, model, fit(docs, labels, model))
    scored = docs.select("doc_id", held_out(parts=5, part=0).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
