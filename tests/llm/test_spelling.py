"""Spelling variants against a brute-force version, whatever the size of the trie's parts."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import spelling


def near(a, b):
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return a in cut(b) or b in cut(a)


def counted(docs, spoil=199, min_chars=6, min_count=5):
    """Words of ``(doc id, text)`` by the letter of the contract."""
    n = Counter()
    for d, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if spoil and h % spoil == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def grouped(n, ratio=5):
    out, form = {}, {}
    for w in n:
        mates = [x for x in n if near(w, x)]
        best = min(mates, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(mates)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n.get(form[w])))
    return rows


def words(seed, count):
    """Words of few letters, so that many are near, with anagrams and accents."""
    r = random.Random(seed)
    out = set()
    while len(out) < count:
        w = "".join(r.choices("abéßz", k=r.randint(6, 8)))
        out |= {w, w[: r.randrange(6)] + r.choice("abcxÿ") + w[6:], "".join(sorted(w))}
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("shard", [1, 7, 50, 20_000])
def test_every_near_word_is_found_once(spark, shard):
    r = random.Random(shard)
    n = {w: r.choice([1, 1, 2, 5, 10, 25, 130, 700]) for w in words(shard, 150)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert {tuple(x) for x in spelling.group_variants(df, shard=shard).collect()} == grouped(n)


def test_one_leaf_of_many_words_is_dealt_out_in_blocks(spark):
    """Words with one vector of counts differ in no level of the trie."""
    n = {w: 1 + k for k, w in enumerate(sorted({"".join(random.Random(k).sample("aaabbbqq", 8)) for k in range(300)}))}  # a and q share a group
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert spelling.trie_depth(spelling.vectors(df), 5) == spelling.GROUPS
    assert {tuple(x) for x in spelling.group_variants(df, shard=5).collect()} == grouped(n)


def test_chains_end_at_their_root(spark):
    n = {"abcdef" + "x" * k: 10**k for k in range(7)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.group_variants(df).collect()}
    assert set(got.values()) == {"abcdefxxxxxx"}


def test_the_query_on_odd_rows(spark):
    r = random.Random(3)
    vocabulary = words(5, 40)
    docs = [(k, " ".join(r.choices(vocabulary, k=300))) for k in range(40)]
    docs += [(None, "ÉtioNs étions"), (None, None), (7, ""), (8, None), (9, "ÉTIONS " * 9 + "Étions9étions×étions" + "İstanbul" * 8)]
    docs += [docs[0], docs[0], (50, "x" * 200_000 + " " + "aBcDeFg\x00" * 6), (51, "aaaaaaaa " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("mine").alias(c) for c in ("word", "n", "part", "block", "counts")]).repartition(5)
    got = [tuple(x) for x in spelling.digest(df).collect()]
    assert len(got) == len(set(got)) and set(got) == grouped(counted(docs))
    plain = [tuple(x) for x in spelling.group_variants(spelling.word_counts(df)).collect()]
    assert set(plain) == grouped(counted(docs, spoil=None))
    assert spelling.digest(df.limit(0)).count() == 0 and spelling.digest(df.where("text IS NULL")).count() == 0


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(k, "abcdef ghijkl mnopqr stuvwx") for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, spoil=199).collect()} == counted(docs)
