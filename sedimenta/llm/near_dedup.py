"""MinHash near-duplicate detection.

Each document's set of word shingles gets a one-permutation MinHash sketch
with optimal densification, cut into bands. Documents with equal sets are one
node, and a node's name starts with its number of bucket mates, most first. In
every bucket (nodes equal in a band) the node with the smallest name is the
centre of a star, and only star edges are compared, so a bucket of n nodes
gives n - 1 pairs. All links are confirmed on full sets.

A bucket that a star leaves in several components gets a second star around a
node outside the largest one. What is still apart is compared in tiles: blocks
of nodes, bounded by their shingles, meet inside a task, which returns a
spanning forest of its links. So every pair that shares a bucket is either
compared, or known to be in one component, or excluded by the sizes of its
sets; no group is capped. Rows of hot keys (centres, buckets, equal texts) are
joined where they are or dealt out by salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import HOT, WordHashes, bounded_batches, join_hot, mix, shingle_set, small_side, stage

#: Bands of rows: a pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^5)^30 = 0.999993.
BANDS, ROWS = 30, 5
#: Nodes and shingles to a block of a tile, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
EMPTY = np.uint64(2**64 - 1)


def sketch(shingles: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One hash splits the shingles into bins; a bin's value is its smallest.

    Empty bins take the value of a bin drawn by hashes of (bin, attempt) until
    that one is not empty; two sketches draw alike, which is what makes
    their agreement an unbiased estimate.
    """
    out = np.full(bins, EMPTY)
    at = (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # sorted shingles: a bin's first is its smallest
    out[at[first]] = shingles[first]
    full = out != EMPTY
    todo, attempt = np.flatnonzero(~full), 1
    while len(todo):
        drawn = (mix(todo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[drawn]
        out[todo[hit]] = out[drawn[hit]]
        todo, attempt = todo[~hit], attempt + 1
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in sk.reshape(bands, rows).T:
        key = mix(key * np.uint64(31) + column)
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, text_key, n, node, keys)`` of ``(doc_id, text_key, text)``; node: a 128-bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ns, nodes, keys = [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text.encode("utf-8", "surrogatepass") if text else b"", size, hashes)
                ns.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "node", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, node binary, keys array<long>")


def node_sets(docs: DataFrame, size: int) -> DataFrame:
    """``(node, n, shingles)`` of the documents given, as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(x.encode("utf-8", "surrogatepass") if x else b"", size, hashes) for x in b.column(0).to_pylist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "n", "shingles"])

    return docs.mapInArrow(run, "node binary, n long, shingles array<long>")


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def node_of(name: str) -> Column:
    """The digest in a name, which starts with 4 bytes of degree."""
    return F.expr(f"substring({name}, 5, 16)")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges ``(a, b)`` between names whose full sets have 100 * intersection >= percent * union.

    The sets of ``b`` with many edges are sent as often as it takes to deal
    those edges out, which is fewer than ``HOT`` times more in all.
    """
    edges = stage(edges, "edges")
    centres = stage(edges.groupBy("b").agg(F.count(F.lit(1)).alias("rows")), "edge-centres")
    total = centres.agg(F.sum("rows")).first()[0] or 0
    hot = centres.where(F.col("rows") * HOT > total).select(F.col("b").alias("h"), F.ceil(F.col("rows") * HOT / F.lit(total or 1)).cast("int").alias("salts"))
    dealt = edges.join(F.broadcast(hot), F.col("b") == F.col("h"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    right = right.join(F.broadcast(hot.withColumn("h", node_of("h"))), F.col("y") == F.col("h"), "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    dealt = dealt.withColumn("x", node_of("a")).withColumn("y", node_of("b"))
    pairs = dealt.join(left, "x").join(right, (dealt.y == right.y) & (F.col("salt") == F.col("to"))).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return pairs.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of all nodes in ``edges (a, b)``; ``comp`` is a component's smallest node.

    Large-star and small-star steps in turn link a node's neighbours to the
    smallest node it knows, until the edges are stars around each component's
    smallest. Edges go from the larger node to the smaller, and neighbourhoods
    are reduced by partial aggregation, never gathered.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        low = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        heads = stage(now.groupBy("b").agg(F.count(F.lit(1)).alias("rows")).join(low, "b", "left"), "links-heads")
        total, chained = heads.agg(F.sum("rows"), F.count("m")).first()  # nodes with larger and smaller neighbours
        large = stage(join_hot(now, heads, "b", "rows", total=total).select("a", F.coalesce("m", "b").alias("b")).distinct(), "links-large") if chained else now
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
        several = stage(low.where("rows > 1"), "links-several")
        total = several.agg(F.sum("rows")).first()[0]  # edges of nodes with several smaller neighbours
        if not total:
            if not chained:
                break
            now = large
        else:
            lowest = join_hot(large, several, "a", "rows", total=total).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = stage(lowest.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links-small")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", F.col("b")).distinct())


TILE = "a binary, b binary"


def tile_links(percent: int):
    """A spanning forest of the links between the outside nodes of a tile and its members in other components.

    Pairs that links found so far have brought together are not compared, nor
    are those that share a bucket of an earlier band, where they are compared.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        outside, inside = pdf[pdf.outside], pdf[~pdf.outside]
        if not len(outside) or not len(inside):
            return pd.DataFrame({"a": [], "b": []})
        band = int(pdf.band.iloc[0])
        ki = np.stack(inside["keys"].to_numpy())[:, :band]
        ni, name_i = inside.n.to_numpy(), inside.name.to_numpy()
        comp_i, comp_o = np.split(pd.factorize(pd.concat([inside.comp, outside.comp]))[0], [len(inside)])
        flat = np.concatenate(inside.shingles.to_list())
        owner = np.repeat(np.arange(len(inside)), ni)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        links = []
        for k, (keys, n, name, s) in enumerate(zip(outside["keys"], outside.n, outside.name, outside.shingles)):
            open_pairs = (comp_i != comp_o[k]) & (np.minimum(ni, n) * 100 >= np.maximum(ni, n) * percent) & ~(ki == keys[:band]).any(axis=1)
            if open_pairs.any():
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                at = np.concatenate([owner[a:b] for a, b in zip(lo, hi) if b > a] or [np.zeros(0, np.int64)])
                both = np.bincount(at, minlength=len(ni))
                for j in np.flatnonzero(open_pairs & (both * 100 >= (ni + n - both) * percent)):
                    if comp_i[j] != comp_o[k]:
                        links.append((name, name_i[j]))
                        old, new = comp_i[j], comp_o[k]
                        comp_i[comp_i == old], comp_o[comp_o == old] = new, new
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def unresolved(live: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets that lie in several components: ``(key, band, name, n, comp, out, members, blocks, outer)``.

    ``out`` marks those that are not in the bucket's largest component, and
    ``blocks`` and ``outer`` are how many blocks all and those are cut into.
    """
    named = live.join(comps.withColumnRenamed("node", "name"), "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    named = stage(named, "members")
    per = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = per.groupBy("key").agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("members"), F.sum("s").alias("size"), F.count(F.lit(1)).alias("n_comps")).where("n_comps > 1")
    cut = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    top = top.select("key", F.col("top.comp").alias("main"), "members", cut(F.col("members"), F.col("size")).alias("blocks"), cut(F.col("members") - F.col("top.c"), F.col("size") - F.col("top.s")).alias("outer"))
    return join_hot(named, stage(top, "apart"), "key", "members").withColumn("out", F.col("comp") != F.col("main")).drop("main", "mates")


def star_edges(members: DataFrame, centres: DataFrame, rows: str, percent: int) -> DataFrame:
    """Edges from the members of buckets to their centres ``(key, centre, cn)``, where sizes and components let a link be new."""
    star = join_hot(members, centres, "key", rows).where((F.col("name") != F.col("centre")) & sizes_allow(F.col("n"), F.col("cn"), percent))
    if "comp" in star.columns:
        star = star.where(F.col("comp") != F.col("cc"))
    return star.select(F.greatest("name", "centre").alias("a"), F.least("name", "centre").alias("b")).distinct()


def find_links(docs: DataFrame, sk: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(nodes, components)``: representatives of equal sets with their number of rows, and the linked ones' components."""
    nodes = sk.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    nodes = stage(nodes, "nodes")
    # One document for each set gives its buckets; a set whose documents all lack an id is found by its digest alone.
    first = sk.join(nodes.select(F.col("node").alias("x"), "rep"), (F.col("node") == F.col("x")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    rows = stage(first.select("node", "n", F.posexplode("keys").alias("band", "key")), "bands")
    many = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"), "buckets")
    live = stage(join_hot(rows, many, "key", "mates").distinct(), "bucket-members")
    degree = F.expr("unhex(lpad(hex(2147483647 - least(degree, 2147483647)), 8, '0'))")
    names = live.groupBy("node").agg(F.sum(F.col("mates") - 1).alias("degree")).select("node", F.concat(degree, "node").alias("name"))
    live = stage(live.join(names, "node").drop("node"), "members")
    lowest = F.min(F.struct("name", "n")).alias("c")
    centres = live.groupBy("key").agg(lowest, F.max("mates").alias("rows")).select("key", "rows", F.col("c.name").alias("centre"), F.col("c.n").alias("cn"))
    edges = star_edges(live, stage(centres, "centres"), "rows", percent)
    wanted = live.select(node_of("name").alias("node")).distinct().join(nodes.where(F.col("rep").isNotNull()), "node").select(F.col("rep").alias("w")).distinct()
    wanted = small_side(stage(wanted, "wanted"))
    own = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("w"), "left_semi").unionByName(docs.select("doc_id", "text").where(F.col("doc_id").isNull()))
    sets = stage(node_sets(own.select("text"), size).dropDuplicates(["node"]), "sets")
    links = stage(confirm(edges, sets, percent), "confirmed")
    comps = stage(components(links), "components")
    rest = stage(unresolved(live, comps), "unresolved")
    if not rest.isEmpty():  # a star around the best node outside the largest component
        lowest = F.min(F.struct("name", "n", "comp")).alias("c")
        second = rest.where("out").groupBy("key").agg(lowest, F.max("members").alias("rows")).select("key", "rows", F.col("c.name").alias("centre"), F.col("c.n").alias("cn"), F.col("c.comp").alias("cc"))
        links = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(confirm(star_edges(rest, stage(second, "centres"), "rows", percent), sets, percent))
        comps = stage(components(links), "components")
        rest = stage(unresolved(live, comps), "unresolved")
    if not rest.isEmpty():
        block = lambda c: F.pmod(F.xxhash64("name"), c).cast("int")
        inner = rest.select("key", "band", "name", "n", "comp", F.lit(False).alias("outside"), F.explode(F.expr("sequence(0, outer - 1)")).alias("i"), block(F.col("blocks")).alias("j"))
        outer = rest.where("out").select("key", "band", "name", "n", "comp", F.lit(True).alias("outside"), block(F.col("outer")).alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
        bands = first.select("node", "keys").dropDuplicates(["node"])
        full = sets.select("node", "shingles").join(bands, "node")
        tiles = inner.unionByName(outer).withColumn("node", node_of("name")).join(full, "node").drop("node")
        more = tiles.groupBy("key", "i", "j").applyInPandas(tile_links(percent), TILE)
        comps = stage(components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)), "components")
    return nodes, comps.select(node_of("node").alias("node"), node_of("comp").alias("comp"))


def component_ids(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n, component_id`` of every row; ``text_key`` is the text's xxhash64."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    sk = stage(sketches(docs, size), "sketches")
    nodes, comps = find_links(docs, sk, size, percent)
    named = nodes.join(comps, "node", "left")
    smallest = stage(named.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")), "smallest")
    linked = join_hot(stage(named.where(F.col("comp").isNotNull()), "linked"), smallest, "comp", "members").select("node", "rows", F.coalesce("component_id", "rep").alias("component_id"))
    ids = stage(linked.unionByName(named.where(F.col("comp").isNull()).select("node", "rows", F.col("rep").alias("component_id"))), "component-ids")
    out = sk.where(F.col("node").isNotNull()).select("doc_id", "text_key", "n", "node")
    out = join_hot(out, ids, "node", "rows").select("doc_id", "text_key", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(sk.where(F.col("node").isNull()).select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs (doc_id, text)``.

    Null and empty texts, and texts without words, have no shingles and are
    linked with nothing. Rows with one text are linked whatever their ids;
    rows without an id are linked too, take the component's id and are never
    kept unless nothing links them. Rows that repeat an id and its text are
    both kept or both not. Long texts are taken whole; an empty table gives an
    empty one. Extra columns are left out.
    """
    found = component_ids(docs, size, percent)
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", same.alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the smallest id; all columns stay.

    A row goes by its own text: of rows that share an id, those whose text
    belongs to another component's smallest id go, and an id that is kept for
    one component is not dropped for another. Rows without an id stay, as no
    decision can name them; null and empty texts stay, as nothing links them.
    An empty table stays empty.
    """
    found = component_ids(docs, size, percent)
    lost = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("lost"), "text_key").distinct()
    lost = small_side(stage(lost, "near-duplicates"), width=32)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text"))
    return rows.join(lost, (F.col("doc") == F.col("lost")) & (F.col("text") == F.col("text_key")), "left_anti").select("row.*")
