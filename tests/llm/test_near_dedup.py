import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import near_dedup as N
from sedimenta.llm import staging
from sedimenta.llm.staging import WordHashes, shingle_set


def texts(seed=1, groups=12, copies=6):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 400)) for _ in range(r.choice([1, 2, 8, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            out.append(" ".join(w).upper() if r.random() < 0.3 else "  ".join(w))
    return list(enumerate(out))


def got(spark, docs, size, **extra):
    df = spark.createDataFrame(docs, brute.DOCS)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df.repartition(3), size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    docs = texts()
    assert got(spark, docs, size) == brute.components(docs, size)


def test_star_members_that_link_without_the_centre(spark, monkeypatch):
    """Chains: neighbours are near, ends are not, so a star leaves components to tiles of two nodes."""
    monkeypatch.setattr(N, "BLOCK", 2)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join([f"y{k}" if k < 7 * i else w for k, w in enumerate(base)])) for i in range(12)]
    docs += [(100 + i, " ".join([f"z{k}" if k >= 120 - 11 * i else w for k, w in enumerate(base)])) for i in range(1, 8)]
    assert got(spark, docs, 2) == brute.components(docs, 2)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, long), (7, long + " end"), (8, "one two"), (9, "one  two")]
    want = brute.components(docs, 2)
    assert got(spark, docs, 2) == want and want[7][1] == 6 and want[1] == (0, 1) and want[2] == (0, 2)
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "q r s"), (None, None)], brute.DOCS).select("*", F.lit(1).alias("n"), F.lit(2).alias("node"), F.lit(3).alias("keys"))
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(twice, 2).collect()), key=str)
    assert rows == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (2, 2, True), (None, None, True)], key=str)
    assert N.near_duplicates(twice.limit(0), 2).collect() == []
    kept = N.drop_near_duplicates(twice, 2)
    assert kept.columns == twice.columns and kept.count() == 5


def test_sketches_estimate_similarity():
    hashes, r = WordHashes(), random.Random(3)
    for n in (3, 40, 2000):
        a = [f"a{i}" for i in range(n)]
        b = a[: int(n * 0.9)] + [f"b{i}" for i in range(n - int(n * 0.9))]
        x, y = (shingle_set(" ".join(w).encode(), 1, hashes) for w in (a, b))
        s, t = N.sketch(x, 3000), N.sketch(y, 3000)
        assert not (s == N.EMPTY).any()
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s == t).mean() - truth) < (0.35 if n == 3 else 0.12)
    assert r


def test_components_of_paths_and_stars(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    name = lambda x: f"{x:05d}".encode()
    edges = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary")
    out = {bytes(r["node"]): bytes(r["comp"]) for r in N.components(edges).collect()}
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {name(x): name(find(x)) for p in pairs for x in p if p[0] != p[1]}
    assert out == want
    assert N.components(edges.limit(0)).collect() == []


def test_cliques_under_a_foreign_centre_give_a_forest(spark):
    """Tiles return links in number of their nodes, not of their pairs."""
    rows = []
    for k in range(3):
        core = np.arange(k * 10**6, k * 10**6 + 60)
        for i in range(100):
            name = f"{k}-{i}".encode().rjust(20, b"0")
            rows += [{"outside": out, "band": 3, "name": name, "n": 62, "comp": name, "keys": np.arange(i * 30, i * 30 + 30), "shingles": np.sort(np.r_[core, [k * 10**6 + 1000 + i, k * 10**6 + 2000 + i]])} for out in (True, False)]
    out = N.tile_links(80)(pd.DataFrame(rows))
    assert len(out) == 3 * 99


def test_large_clique_of_texts_unlike_their_bucket_centre(spark, monkeypatch):
    """Every text shares buckets with a hub that is like none of them; the clique's links stay linear and no key stays hot."""
    told = {}
    monkeypatch.setattr(N, "stage", lambda df, label: told.setdefault(label, []).append(out := staging.stage(df, label)) or out)
    base = [f"w{i}" for i in range(120)]
    docs = [(i + 1, " ".join([*base[:110], *(f"v{i}-{k}" for k in range(3)), *base[110:]])) for i in range(5000)]
    friends = [(6000 + i, f"f{i} g{i} h{i}") for i in range(40)]

    def keys(sk, bands, rows):  # two buckets are everyone's; the friends have a third, so one of them is the centre
        own = N.mix(sk[:bands] + np.arange(bands, dtype=np.uint64)).view(np.int64)
        return np.where(np.arange(bands) < (3 if len(np.unique(sk)) <= 2 else 2), np.arange(bands), own)

    monkeypatch.setattr(N, "band_keys", keys)
    found = got(spark, [*docs, *friends], 2)
    assert {c for d, (_, c) in found.items() if d <= 5000} == {1} and all(found[d] == (2, d) for d, _ in friends)
    links = {name: [df.count() for df in frames] for name, frames in told.items() if "link" in name or name in ("edges", "confirmed")}
    assert max(n for counts in links.values() for n in counts) <= 12 * len(docs), links


def test_recall_of_bands_at_the_threshold():
    """Random pairs of similarity 0.8 to 0.82 share a bucket."""
    r, hashes = np.random.default_rng(7), WordHashes()
    missed = tried = 0
    for n in (4, 9, 45, 180, 900):
        for _ in range(120):
            union = [f"{x}" for x in r.integers(0, 1 << 60, n)]
            cut = n // 5  # in one of both only
            a, b = union[: n - cut // 2], union[cut - cut // 2 :]
            x, y = (shingle_set(" ".join(w).encode(), 1, hashes) for w in (a, b))
            assert 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
            keys = [N.band_keys(N.sketch(s), N.BANDS, N.ROWS) for s in (x, y)]
            missed += not (keys[0] == keys[1]).any()
            tried += 1
    assert tried == 600 and missed == 0


def test_rows_go_by_their_own_text(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    docs = spark.createDataFrame([(5, a), (9, a), (3, b), (5, b), (7, None), (7, "")], brute.DOCS)
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("lost", "row", "text_key", "__lost", "node", "key")))
    kept = N.drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, a), (3, b), (7, None), (7, "")], key=str)
