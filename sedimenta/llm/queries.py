"""The production queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, line_dedup, mixing, near_dedup, prefix_trie, quality, rules, spelling, substring_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _over(fn: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": _over(lambda docs: near_dedup.near_duplicates(docs, size=2), "documents"),
        "op2_quality": _over(quality.digest, "documents", "labels"),
        "op3_chat": _over(chat.digest, "conversations"),
        "op4_html": _over(html_extract.extract, "pages"),
        "op5_line_dedup": _over(line_dedup.digest, "documents"),
        "op6_rules": _over(rules.digest, "documents"),
        "op7_warc": _over(warc.digest, "pages"),
        "op8_mixing": _over(mixing.query, "documents"),
        "op9_toxicity": _over(toxicity.digest, "documents", "labels"),
        "op10_decontaminate": _over(decontaminate.digest, "documents", "benchmark"),
        "op11_spelling": _over(spelling.digest, "documents"),
        "op12_substring_dedup": _over(substring_dedup.digest, "documents"),
        "op13_prefix_trie": _over(prefix_trie.digest, "conversations"),
    }
