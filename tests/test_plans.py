"""Physical plans: what reaches the scan, and where rows are limited before a shuffle."""

import contextlib
import io
import re

from sedimenta.plans import queries as Q

DIR = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Q.select_filter(spark, DIR))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThanOrEqual(o_totalprice,150000.0)" in text
    assert "o_orderdate" not in text and "Exchange" not in text


def test_latest_rows_are_limited_before_the_shuffle(spark):
    text = plan(Q.latest_per_key(spark, DIR))
    assert text.count("WindowGroupLimit") >= 2 and text.count("Exchange hashpartitioning") <= 2


def test_gates_and_cleaning_stay_in_one_stage(spark):
    for query in (Q.gate_valid, Q.gate_quarantine, Q.clean_strings, Q.parse_duration, Q.row_hash):
        text = plan(query(spark, DIR))
        assert "Exchange" not in text and "Python" not in text


def test_small_dimensions_are_broadcast_and_top_k_is_not_sorted_whole(spark):
    assert "BroadcastHashJoin" in plan(Q.enrich_left(spark, DIR))
    assert "TakeOrderedAndProject" in plan(Q.top_k(spark, DIR))


def test_ranges_of_files_are_found_without_a_sort_of_their_rows(spark):
    steps = re.findall(r"^\(\d+\) ([A-Z]\w+)", plan(Q.compact_ranges(spark, DIR)), re.M)
    assert "Sort" not in steps[: steps.index("HashAggregate")] and steps.index("HashAggregate") < steps.index("Exchange")


def test_every_query_has_sql(spark):
    import __spark_entry__ as entry

    missing = set(entry.queries()) - set(entry.oracle_sql())
    assert missing <= {"op2_quality", "op4_html", "op9_toxicity", "pipeline"}
    assert Q.prepare_updates(spark, DIR).count() > 0 and entry.entry(spark).columns[0] == "o_custkey"
