"""Extra columns named like anything that an operator uses inside change nothing and are not lost."""

import functools
import inspect
import re

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import chat, decontaminate, html_extract, line_dedup, mixing, near_dedup, prefix_trie, quality, rules, spelling, staging, substring_dedup, toxicity, warc

DIR = "/root/testdata/sf0.001"
KEEPING = {
    "keep_good": (quality, lambda docs, t: quality.keep_good(docs, t("labels")), "documents"),
    "keep_clean": (rules, lambda docs, t: rules.keep_clean(docs), "documents"),
    "dedup_lines": (line_dedup, lambda docs, t: line_dedup.dedup_lines(docs, min_docs=2), "documents"),
    "drop_near_duplicates": (near_dedup, lambda docs, t: near_dedup.drop_near_duplicates(docs), "documents"),
    "drop_contaminated": (decontaminate, lambda docs, t: decontaminate.drop_contaminated(docs, t("benchmark")), "documents"),
    "drop_repeats": (substring_dedup, lambda docs, t: substring_dedup.drop_repeats(docs), "documents"),
    "mix_sources": (mixing, lambda docs, t: mixing.mix_sources(docs), "documents"),
}
TELLING = {
    "near_duplicates": (near_dedup, lambda docs, t: near_dedup.near_duplicates(docs, size=2), "documents"),
    "quality": (quality, lambda docs, t: quality.digest(docs, t("labels")), "documents"),
    "chat": (chat, lambda rows, t: chat.digest(rows), "conversations"),
    "line_dedup": (line_dedup, lambda docs, t: line_dedup.digest(docs), "documents"),
    "rules": (rules, lambda docs, t: rules.digest(docs), "documents"),
    "warc": (warc, lambda pages, t: warc.digest(pages), "pages"),
    "toxicity": (toxicity, lambda docs, t: toxicity.digest(docs, t("labels")), "documents"),
    "decontaminate": (decontaminate, lambda docs, t: decontaminate.digest(docs, t("benchmark")), "documents"),
    "spelling": (spelling, lambda docs, t: spelling.digest(docs), "documents"),
    "substring_dedup": (substring_dedup, lambda docs, t: substring_dedup.digest(docs), "documents"),
    "prefix_trie": (prefix_trie, lambda rows, t: prefix_trie.digest(rows), "conversations"),
    "html": (html_extract, lambda pages, t: html_extract.extract(pages), "pages"),
}


def names_in(module, taken):
    """Every plain word that the module and its helpers have in quotes, but the columns of the table."""
    found = set()
    for m in (module, staging):
        for text in re.findall(r'"([^"\n]*)"|\'([^\'\n]*)\'', inspect.getsource(m)):
            found |= set(re.findall(r"(?<![\w.])[a-z_]\w*(?![\w(])", "".join(text)))
    return sorted(x for x in found | {"row"} if x not in taken)


def table(spark, name):
    df = spark.read.parquet(f"{DIR}/{name}.parquet")
    return df.where("conv_id < 4") if name == "conversations" else df


def told(df, columns):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=str)


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay(spark, name):
    module, apply, source = KEEPING[name]
    docs, t = table(spark, source), functools.partial(table, spark)
    extra = [x for x in names_in(module, docs.columns) if x not in ("copy", "shuffle_key")]
    assert len(extra) > 10
    got = apply(docs.select("*", *[F.lit(f"mine {x}").alias(x) for x in extra]), t)
    plain = apply(docs, t)
    assert got.columns[: len(docs.columns) + len(extra)] == [*docs.columns, *extra]
    assert told(got, plain.columns) == told(plain, plain.columns)
    assert got.where(" OR ".join(f"NOT `{x}` <=> 'mine {x}'" for x in extra)).isEmpty()


@pytest.mark.parametrize("name", TELLING)
def test_results_stay(spark, name):
    module, apply, source = TELLING[name]
    df, t = table(spark, source), functools.partial(table, spark)
    extra = names_in(module, df.columns)
    got, plain = apply(df.select("*", *[F.lit("mine").alias(x) for x in extra]), t), apply(df, t)
    assert got.columns == plain.columns and told(got, plain.columns) == told(plain, plain.columns)
