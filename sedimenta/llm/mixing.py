"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

Each source has a repetition rate: the mean number of copies of one of its
documents. A document's number of copies is the inverse of the Poisson
distribution function with that mean at a uniform number hashed from the seed
and the document id, so it depends on nothing else: reruns, retries and other
partitionings give the same mixture. A mean beyond 16 is drawn as the sum of
Poisson numbers with means of at most 16, each from a uniform number of its
own, which is the same distribution. Copies are then dealt out by a hash of
seed, id and copy number and sorted by it, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from .staging import stage

#: Rates tables with at most this many sources are broadcast; larger ones are joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: A larger mean is drawn in slices of this mean.
SLICE = 16.0
#: Copies made by one array at most.
COPIES = 4096


def terms(max_rate: float) -> int:
    """How many terms of the distribution function reach 1 to double precision."""
    return int(max_rate + 10 * max_rate**0.5 + 24)


TERMS = terms(SLICE)


def uniform(seed: int, key: Column, part: Column | None = None) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest; each ``part`` has one of its own."""
    start = F.lit(str(seed)) if part is None else F.concat_ws("/", F.lit(str(seed)), part.cast("string"))
    digest = F.md5(F.concat_ws(":", start, key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source", max_rate: float | None = None) -> DataFrame:
    """``(source, n_docs, weight, rate, missed)``; rate = total * weight / n_docs.

    With ``max_rate`` the rate is at most that, and ``missed`` is the number of
    documents by which a source's mean falls short of its weight for it.

    ``weights`` gives each source's share of the mixture (scaled to sum to 1;
    sources without one get none). Without weights every source weighs alike.
    ``total`` is the wanted number of documents: by default as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        shares = counts.withColumn("share", F.lit(1.0))
    else:
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in weights.items()])
        share = F.map_from_entries(pairs)[F.col("source")] if weights else F.lit(0.0)
        shares = counts.withColumn("share", F.coalesce(share, F.lit(0.0)))
    shares = stage(shares, "mix-shares")  # a row for each source
    all_share, all_docs = shares.agg(F.sum("share"), F.sum("n_docs")).first()
    weight = F.col("share") / F.lit(float(all_share)) if all_share else F.lit(0.0)
    wanted = float(total if total is not None else all_docs or 0)
    full = F.lit(wanted) * F.col("weight") / F.col("n_docs")
    rate = full if max_rate is None else F.least(F.lit(float(max_rate)), full)
    return shares.select("source", "n_docs", weight.alias("weight")).withColumn("rate", rate).withColumn("missed", (full - F.col("rate")) * F.col("n_docs"))


def with_cdf(rates: DataFrame, n: int = TERMS) -> DataFrame:
    """Adds ``cdf``: the Poisson distribution function at 0, 1, 2, ... for each rate."""
    step = "struct(acc.term * rate / k AS term, acc.total + acc.term * rate / k AS total, array_append(acc.cdf, acc.total + acc.term * rate / k) AS cdf)"
    fold = f"aggregate(sequence(1, {n}), struct(exp(-rate) AS term, exp(-rate) AS total, array(exp(-rate)) AS cdf), (acc, k) -> {step}).cdf"
    return rates.withColumn("cdf", F.expr(fold))


def with_slices(rates: DataFrame) -> DataFrame:
    """Cuts each rate into ``full`` slices of mean ``SLICE`` and the rest: ``source, full, cdf, full_cdf`` (null without full slices)."""
    full = F.greatest(F.lit(0), F.ceil(F.col("rate") / SLICE) - 1).cast("int")
    cut = rates.withColumn("full", full).withColumn("rate", F.col("rate") - F.col("full") * SLICE)
    rest = with_cdf(cut).select("source", "full", F.col("cdf").alias("rest"))
    whole = with_cdf(rest.withColumn("rate", F.lit(SLICE)))
    return whole.select("source", "full", F.col("rest").alias("cdf"), F.when(F.col("full") > 0, F.col("cdf")).alias("full_cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", max_rate: float | None = None) -> DataFrame:
    """``docs`` replicated to the target weights and globally shuffled.

    All columns stay; ``copy`` (from 0) and ``shuffle_key`` are added (or take
    the place of columns so named), and the rows are sorted by ``shuffle_key``
    within partitions that it was dealt to. Every source meets its weight
    unless ``max_rate`` bounds its mean; ``source_rates`` tells what it then
    misses. A null source is a source of its own (weighed under the plain
    default, out of a given ``weights``). A null id hashes as the empty text.
    Rows that repeat an id get equal counts; texts, null or long, play no part.
    Ties of ``shuffle_key`` keep no set order. An empty table gives an empty one.
    """
    rates = stage(with_slices(source_rates(docs, weights, total, source_col, max_rate)), "mix-rates")
    own = free_prefix(docs.columns)  # of the columns used on the way; a struct around the row would be cut up wrongly by the optimiser when a reader takes some of its fields through two explodes
    c = lambda x: F.col(own + x)
    broadcast = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(*[F.col(x).alias(own + x) for x in rates.columns])
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in ("copy", "shuffle_key")]
    rows = docs.select(*kept, F.col(source_col).alias(own + "of"), name.alias(own + "name"), uniform(seed, name).alias(own + "u"))
    if broadcast:
        joined = rows.join(F.broadcast(rates), c("of").eqNullSafe(c("source")))
    else:
        salted = rates.withColumn(own + "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(own + "slot", F.floor(c("u") * SALTS).cast("int"))
        joined = rows.join(salted, c("of").eqNullSafe(c("source")) & (c("slot") == c("salt")))
    below = lambda cdf, at: F.size(F.filter(cdf, lambda x: x <= at))

    def add(n: Column, k: Column) -> Column:
        return n + below(F.when(k < c("full"), c("full_cdf")).otherwise(c("cdf")), uniform(seed, c("name"), k))

    n = F.when(c("full") == 0, below(c("cdf"), c("u"))).otherwise(F.aggregate(F.sequence(F.lit(1), c("full")), below(c("full_cdf"), c("u")), add))
    key = F.concat_ws(":", F.lit(str(seed)), c("name"), F.col("copy").cast("string"))
    return (
        joined.select(*kept, c("name"), n.alias(own + "n"))
        .where(c("n") > 0)
        .withColumn(own + "from", F.explode(F.expr(f"sequence(0, {own}n - 1, {COPIES})")))
        .withColumn("copy", F.explode(F.expr(f"sequence({own}from, least({own}n, {own}from + {COPIES}) - 1)")))
        .select(*kept, "copy", F.md5(key.cast("binary")).alias("shuffle_key"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def query(docs: DataFrame) -> DataFrame:
    """Sources mixed in equal shares; as many documents as the table has, in the mean."""
    return mix_sources(docs.select("doc_id", "text", "lang", "source", "n_chars"))
