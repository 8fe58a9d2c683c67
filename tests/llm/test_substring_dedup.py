"""Removal of repeated word sequences against a brute-force version, at several sizes and on both ways of joining."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import staging, substring_dedup


def cut(docs, size):
    """``(kept words, removed)`` of each row."""
    held = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = {}
    for row, words in enumerate(held):
        for i in range(len(words) - size + 1):
            seen.setdefault(tuple(words[i : i + size]), []).append((row, i))
    gone = {(row, i + j) for places in seen.values() if len(places) > 1 for row, i in places for j in range(size)}
    return [([w for i, w in enumerate(words) if (row, i) not in gone], sum((row, i) in gone for i in range(len(words)))) for row, words in enumerate(held)]


def told(docs, size):
    return sorted(((d, len(k) + n, n, hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, _), (k, n) in zip(docs, cut(docs, size))), key=str)


def made(seed, size, letters="abcdefgh"):
    """Texts with shared passages about as long as a window, edits inside copies, periods, and texts of few words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(letters, k=r.choice([1, 1, 4])))
    passages = [[word() for _ in range(n)] for n in (size - 1, size, size + 1, 2 * size, 3 * size + 1) if n > 0]
    docs = []
    for _ in range(40):
        words = [word() for _ in range(r.randrange(3 * size))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages)
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = "ÉDIT"
        docs.append(r.choice([" ", "\n", "\t \x0b"]).join(words))
    return docs + [docs[0], docs[1], docs[1] + " end", " ".join(["x"] * (size + 3)), " ".join(["p", "q", "r"] * size), "", " \n "]


@pytest.mark.parametrize("size", [1, 2, 3, 9, 10, 17, 35, 80])
@pytest.mark.parametrize("broadcast", [True, False])
def test_as_brute_force(spark, monkeypatch, size, broadcast):
    if not broadcast:
        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    docs = list(enumerate(made(size, size)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marked = substring_dedup.with_cuts(df, size)
    got = marked.select("row.doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256))
    assert sorted((tuple(x) for x in got.collect()), key=str) == told(docs, size)


def test_odd_rows(spark):
    docs = list(enumerate(made(99, 35))) + [(None, None), (None, "w " * 40), (5, None), (3, "w " * 40), (3, "w " * 40), (None, "only me " + " ".join(map(str, range(60)))), (0, "z\x00ß " * 4)]
    docs += [(900, " ".join(str(k % 7919) for k in range(30_000)))]  # a very long text that repeats itself
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("mine").alias(c) for c in ("doc", "text_key", "row", "cut", "ranges", "half", "start", "known")]).repartition(4)
    want = told(docs, 35)
    assert sorted((tuple(x) for x in substring_dedup.digest(df).collect()), key=str) == want
    kept = substring_dedup.drop_repeats(df)
    assert kept.columns == df.columns
    plain = [(d, t if not n else " ".join(k)) for (d, t), (k, n) in zip(docs, cut(docs, 35))]
    assert sorted((tuple(x) for x in kept.select("doc_id", "text").collect()), key=str) == sorted(plain, key=str)
    assert kept.where("NOT (cut = 'mine' AND ranges = 'mine')").isEmpty()
    assert substring_dedup.digest(df.limit(0)).count() == 0


def test_levels_end_when_nothing_repeats(spark):
    docs = [(k, " ".join(f"{k}-{i}" for i in range(60))) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert substring_dedup.lengths(35) == [9, 18, 35]
    assert substring_dedup.repeated_ranges(df).isEmpty()
    assert {r["n_removed"] for r in substring_dedup.digest(df).collect()} == {0}


def test_hot_windows_are_split(spark, monkeypatch):
    """A passage of 40 words in each text, between words of their own: hot half windows, kinds and windows."""
    monkeypatch.setattr(staging, "HOT_ROWS", 5)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(k, f"{' '.join(f'a{k}.{i}' for i in range(k % 30))} {passage} {' '.join(f'b{k}.{i}' for i in range(20))}") for k in range(60)] + [(60, passage), (61, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in substring_dedup.digest(df).collect()), key=str) == told(docs, 35)


@pytest.mark.parametrize("size", [1, 9, 10, 35, 80])
def test_texts_hashed_together_as_one_by_one(monkeypatch, size):
    """Words, runs and spans of a text are the same whatever stands beside it, and the texts are in fact hashed together."""
    texts = [None, "", *made(7, size), " \n ", "z\x00ß " * 50, None, "w " * 300]
    level = substring_dedup.levels(size) - 1

    def told(parts):
        out, k = [], 0
        for part in parts:
            text = substring_dedup.Texts(part, lanes=2)
            r = substring_dedup.Runs(text, size, level)
            owner = text.owner[r.start]
            assert (np.diff(r.start) > 0).all() and (r.start + r.count + size - 1 <= text.first[owner + 1]).all()
            out += zip((k + owner).tolist(), (r.start - text.first[owner]).tolist(), r.count.tolist(), r.hash.tolist(), r.before.tolist(), r.spans(text, size, 0).tolist(), r.spans(text, size, 1).tolist())
            k += len(part)
        assert k == len(texts)
        return out

    alone = told([[t] for t in texts])
    counts = [0] * len(texts)
    for k, _, n, *_ in alone:
        counts[k] += n
    assert counts == [max(0, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) - size + 1) for t in texts]
    for most in (1, 300, 1 << 17):
        monkeypatch.setattr(substring_dedup, "GROUP", most)
        parts = [texts[p] for p in substring_dedup.groups(texts)]
        assert told(parts) == alone and (most > 300 or len(parts) > 1)
    monkeypatch.setattr(substring_dedup, "SLICE", 7)
    assert told([texts]) == alone
    made_for, plain = [], substring_dedup.word_hashes
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda data: made_for.append(data) or plain(data))
    told(parts)
    assert len(made_for) == len(parts) < len(texts)


def test_first_smallest():
    x = np.array([5, 3, 3, 9, 1, 1, 7, 0, 2, 2], np.uint64)
    for width in range(1, 11):
        assert substring_dedup.first_smallest(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(len(x) - width + 1)]
