"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

PIPES = "'||'"
CLEANED = f"""cleaned AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS o_custkey,
    nullif(trim(CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus END), '') AS status, nullif(trim(o_orderpriority), '') AS priority, year(o_orderdate) AS year, o_orderdate FROM orders),
judged AS (SELECT *, o_custkey IS NOT NULL AS ok1, coalesce(status IN ('F', 'O'), false) AS ok2, coalesce(year BETWEEN 1996 AND 2000, false) AS ok3 FROM cleaned)"""
WAVES = """o AS (SELECT o_custkey, o_orderkey, o_orderdate, year(o_orderdate) AS y, o_orderstatus AS st FROM orders),
latest AS (SELECT o_custkey, y, st FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM o) WHERE r = 1),
points AS (SELECT * FROM (SELECT *, lag(st) OVER (PARTITION BY o_custkey ORDER BY y) AS before FROM latest) WHERE before IS DISTINCT FROM st)"""
MESSAGES = """m AS (
  SELECT *, CASE WHEN event_id % 17 = 0 THEN '{"type": "edit", ' WHEN event_id % 19 = 0 THEN '["edit"]'
    ELSE '{"type":"' || CASE WHEN event_type = 'purchase' THEN 'edit' ELSE event_type END || '","meta":{"domain":"' || CASE WHEN user_id % 10 = 0 THEN 'canary' ELSE 'site' END || '"},"id":' || event_id || '}' END AS body FROM events)"""

ODD = "CASE WHEN event_id % 7 = 0 THEN '{\"user_id\":\"zz' || user_id || '\"}' END"
TITLES = """p AS (
  SELECT p_partkey AS k, p_partkey::VARCHAR AS show_id, CASE WHEN p_partkey % 10 = 0 THEN 'Clip' WHEN p_partkey % 2 = 0 THEN 'Movie' ELSE 'TV Show' END AS content_type,
    nullif(trim(CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE p_name END), '') AS title, 1890 + p_size * 4 AS release_year, p_size FROM part),
b AS (SELECT *, 'b1' AS _batch_id, p_size AS duration_value, 'min' AS duration_unit FROM p UNION ALL SELECT *, 'b2', 2, 'Seasons' FROM p WHERE k % 3 = 0),
j AS (SELECT *, title IS NOT NULL AS ok1, content_type <> 'Clip' AS ok2, release_year BETWEEN 1900 AND 2025 AS ok3 FROM b)"""

ORACLES = {
    "select_filter": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000.0 AND o_orderpriority IS NOT NULL",
    "count_by_type": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type",
    "enrich_left": "SELECT o_orderstatus, o_orderkey, status_name FROM orders LEFT JOIN (VALUES ('F', 'finished'), ('O', 'open')) v(s, status_name) ON s = o_orderstatus",
    "flatten_nested": "SELECT p_partkey AS tvmaze_id, p_name AS name, p_brand AS status, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS rating, replace(p_type, ' ', ', ') AS genres, NULL::VARCHAR AS language, NULL::VARCHAR AS premiered FROM part",
    "top_k": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
    "clean_strings": "SELECT p_partkey, nullif(trim(CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE p_name END), '') AS name FROM part",
    "parse_dates": "SELECT o_orderkey, try_strptime(CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%B %-d, %Y') END, '%B %d, %Y')::DATE AS added FROM orders",
    "parse_duration": """WITH d AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' min' WHEN 1 THEN p_size || ' Seasons' WHEN 2 THEN ' ' || p_size || ' min' WHEN 3 THEN p_size::VARCHAR END AS x FROM part)
SELECT p_partkey, nullif(trim(x), '') AS raw, try_cast(nullif(regexp_extract(x, '^(\\d+)', 1), '') AS INTEGER) AS value, CASE WHEN x IS NOT NULL THEN regexp_extract(x, '\\d+\\s+(.*)$', 1) END AS unit FROM d""",
    "base_name_audit": "SELECT event_type, count(*) AS n, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts, true AS named FROM events GROUP BY event_type",
    "row_hash": f"SELECT c_custkey, sha256(concat_ws({PIPES}, c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END)) AS hash FROM customer",
    "ensure_columns": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    "change_batches": f"""WITH b AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS show_id, c_name AS title, c_mktsegment AS segment, 'customers' AS _source_system, sha256(concat_ws({PIPES}, c_custkey, c_name, c_mktsegment)) AS _raw_hash FROM customer)
SELECT show_id, title, segment, 'batch_001_initial' AS _batch_id, 1::BIGINT AS _ingestion_sequence, _source_system, _raw_hash, NULL AS content_language FROM b
UNION ALL SELECT show_id, title, segment, 'batch_002_updates_duplicates', 2, _source_system, _raw_hash, NULL FROM b WHERE k BETWEEN 1 AND 100
UNION ALL SELECT show_id, title, 'PG', 'batch_002_updates_duplicates', 3, _source_system, sha256(concat_ws({PIPES}, show_id, title, 'PG')), NULL FROM b WHERE k = 1
UNION ALL SELECT show_id, title, segment, 'batch_002_updates_duplicates', 2, _source_system, _raw_hash, NULL FROM b WHERE k IN (2, 3)
UNION ALL SELECT show_id, title, segment, 'batch_003_new_column', 4, _source_system, _raw_hash, CASE WHEN segment = 'BUILDING' THEN 'English' ELSE 'Unknown' END FROM b WHERE k BETWEEN 101 AND 150
UNION ALL SELECT NULL, '', segment, 'batch_004_bad_quality_row', 5, _source_system, sha256(concat_ws({PIPES}, '', '', segment)), NULL FROM b WHERE k = 151""",
    "gate_valid": f"WITH {CLEANED} SELECT o_orderkey, o_custkey, status, year::INTEGER AS year FROM judged WHERE ok1 AND ok2 AND ok3",
    "gate_quarantine": f"""WITH {CLEANED} SELECT o_orderkey, concat_ws('; ', CASE WHEN NOT ok1 THEN 'o_custkey is null' END, CASE WHEN NOT ok2 THEN 'status is not F or O' END, CASE WHEN NOT ok3 THEN 'year is outside accepted range' END) AS _quality_errors
FROM judged WHERE NOT (ok1 AND ok2 AND ok3)""",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "prepare_updates": f"""WITH {CLEANED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM judged WHERE ok1 AND ok2 AND ok3)
SELECT o_custkey, o_orderkey, status, priority, year::INTEGER AS year, sha256(concat_ws({PIPES}, o_custkey, status, coalesce(priority, ''), year)) AS _record_hash FROM ranked WHERE r = 1""",
    "classify_changes": f"""WITH {WAVES}, last AS (SELECT max(y) AS y FROM o), past AS (SELECT o_custkey, arg_max(st, l.y) AS st FROM latest l, last WHERE l.y < last.y GROUP BY o_custkey)
SELECT l.o_custkey, l.st, CASE WHEN p.o_custkey IS NULL THEN 'new' WHEN p.st <> l.st THEN 'changed' ELSE 'unchanged' END AS change FROM latest l JOIN last ON l.y = last.y LEFT JOIN past p ON p.o_custkey = l.o_custkey""",
    "scd1_state": f"WITH {WAVES} SELECT o_custkey, arg_max(st, y) AS st, min(y)::INTEGER AS created FROM latest GROUP BY o_custkey",
    "scd2_history": f"""WITH {WAVES} SELECT o_custkey, st, y::INTEGER AS from_year, (lead(y) OVER (PARTITION BY o_custkey ORDER BY y))::INTEGER AS to_year,
  lead(y) OVER (PARTITION BY o_custkey ORDER BY y) IS NULL AS is_current FROM points""",
    "duplicate_keys": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1",
    "quality_report": f"WITH {CLEANED} SELECT sum(CASE WHEN ok1 THEN 0 ELSE 1 END)::BIGINT AS invalid_key, sum(CASE WHEN ok2 THEN 0 ELSE 1 END)::BIGINT AS invalid_status, sum(CASE WHEN ok3 THEN 0 ELSE 1 END)::BIGINT AS invalid_year, sum(CASE WHEN priority IS NULL THEN 1 ELSE 0 END)::BIGINT AS invalid_priority FROM judged",
    "contract_reject": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "contract_evolve": "SELECT c_custkey, c_name, c_nationkey, NULL AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'supplier' FROM supplier",
    "widen_rename_drop": "SELECT c_custkey, c_nationkey::BIGINT AS nation FROM customer",
    "ingest_stream": "SELECT event_id, user_id, event_type FROM events",
    "ingest_evolve": "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, NULL AS severity FROM events UNION ALL SELECT event_id::VARCHAR, user_id::VARCHAR, event_type, 'high' FROM events WHERE event_type = 'error'",
    "ingest_rescue": """SELECT event_id, user_id, event_type, NULL AS _rescued_data FROM events UNION ALL SELECT event_id, user_id, event_type, '{"severity":"high"}' FROM events WHERE event_type = 'error'""",
    "trigger_batches": "SELECT trigger, batches, 6::BIGINT AS files, (SELECT count(*) FROM events) AS rows FROM (VALUES ('available_now', 3::BIGINT), ('once', 1::BIGINT)) v(trigger, batches)",
    "unsafe_reload": "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type",
    "safe_reload": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "decode_messages": f"WITH {MESSAGES} SELECT body AS event_json, 'changes' AS kafka_topic, (user_id % 4)::INTEGER AS kafka_partition, event_id AS kafka_offset, epoch_us(ts) AS enqueued_us FROM m",
    "stream_schema_merge": "SELECT event_id AS kafka_offset, CASE WHEN event_id % 2 = 0 THEN 'changes' END AS kafka_topic, (user_id % 4)::INTEGER AS kafka_partition, CASE WHEN event_id % 2 = 1 THEN (user_id % 4 + 10)::INTEGER END AS shard FROM events",
    "keep_edits": "SELECT event_id AS kafka_offset FROM events WHERE event_type = 'purchase' AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND user_id % 10 <> 0",
    "append_rows": "SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "contract_violations": "SELECT 0::BIGINT AS c_custkey, count(*) FILTER (c_custkey % 5 = 0) AS c_name, count(*) FILTER (c_custkey % 3 = 0) AS c_nationkey FROM customer",
    "csv_inferred": "SELECT p_partkey::INTEGER AS p_partkey, p_name, p_size::INTEGER AS p_size, p_retailprice FROM part",
    "dropped_csv": "SELECT n_nationkey::INTEGER AS n_nationkey, n_name FROM nation",
    "lineage": "SELECT c_custkey, true AS named, epoch_us(TIMESTAMP '2024-05-06 07:08:09') AS ingested_us, DATE '2024-05-06' AS _load_date FROM customer",
    "audit_by_name": "SELECT 5::BIGINT AS files, count(*) AS n, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts FROM events",
    "row_counts": "SELECT way, CASE way WHEN 'delta' THEN count(*) FILTER (o_orderstatus <> 'F') ELSE count(*) END AS rows FROM orders, (VALUES ('sql'), ('frame'), ('table'), ('delta')) v(way) GROUP BY way",
    "sql_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "ingest_rescue_types": f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, event_type, {ODD} AS _rescued_data FROM events",
    "rescued_rows": f"SELECT event_id, {ODD} AS _rescued_data FROM events WHERE event_id % 7 = 0",
    "publish_silver": f"""WITH {TITLES} SELECT show_id, content_type, title, DATE '2020-05-04' AS date_added, release_year::INTEGER AS release_year, duration_value::INTEGER AS duration_value, duration_unit, _batch_id
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY _batch_id DESC) AS r FROM j WHERE ok1 AND ok2 AND ok3) WHERE r = 1""",
    "publish_quarantine": f"""WITH {TITLES} SELECT show_id, _batch_id, concat_ws('; ', CASE WHEN NOT ok1 THEN 'title is null or empty' END, CASE WHEN NOT ok2 THEN 'content_type is not Movie or TV Show' END,
  CASE WHEN NOT ok3 THEN 'release_year is missing or outside accepted range' END) AS _quality_errors FROM j WHERE NOT (ok1 AND ok2 AND ok3)""",
    "title_quality": f"""WITH {TITLES} SELECT 0::BIGINT AS invalid_show_id, count(*) FILTER (NOT ok1) AS invalid_title, count(*) FILTER (NOT ok2) AS invalid_content_type, count(*) FILTER (NOT ok3) AS invalid_release_year, 0::BIGINT AS invalid_duration FROM j""",
    "compact_ranges": "SELECT 3::BIGINT AS num_files, 0::BIGINT AS overlaps",
    "ingest_malformed": r"""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN '{"_corrupt_record":"' || event_id || ',' || user_id || ',' || event_type || ',lost"}'
    WHEN event_id % 11 = 0 THEN '{"user_id":"' || user_id || ',' || event_type || '","_corrupt_record":"' || event_id || ',\"' || user_id || ',' || event_type || '"}' END AS _rescued_data FROM events""",
    "ingest_poison": """WITH good AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error')
SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, NULL AS reason FROM good
UNION ALL SELECT NULL, NULL, NULL, unnest(['the header repeats event_id', 'the header repeats user_id', 'reserved names: _source_file', 'a column has no name'])""",
    "progress_log": """SELECT 1 AS run, 3::BIGINT AS batches, 6::BIGINT AS files, count(*) AS rows, true AS timed FROM events
UNION ALL SELECT 2, 1, 1, count(*), true FROM events WHERE event_type = 'error'""",
    "history_parts": f"""WITH {WAVES}, h AS (SELECT st, lead(y) OVER (PARTITION BY o_custkey ORDER BY y) IS NULL AS current FROM points)
SELECT CASE WHEN current THEN 'current' ELSE 'closed' END AS part, st, count(*) AS n FROM h GROUP BY ALL""",
    "merge_files": "SELECT count(*) FILTER (c_custkey % 4 <> 2) AS rows_left, count(*) FILTER (c_custkey % 4 = 2) AS rows_rewritten, count(*) FILTER (c_custkey % 8 = 2) AS renamed FROM customer",
    "append_once": "SELECT c_custkey, c_name, c_nationkey, NULL AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'supplier' FROM supplier",
    "write_counters": f"""WITH {TITLES} SELECT count(*) AS rows, 0::BIGINT AS invalid_show_id, count(*) FILTER (NOT ok1) AS invalid_title, count(*) FILTER (NOT ok2) AS invalid_content_type, count(*) FILTER (NOT ok3) AS invalid_release_year, 0::BIGINT AS invalid_duration FROM j""",
    "bronze_strings": "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part",
    "reset_tables": "SELECT 'gone' AS name, false AS there, 0::BIGINT AS rows UNION ALL SELECT 'kept', true, count(*) FROM nation",
    "ordered_keys": "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders",
    "counts_in_order": "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type",
    "z_ordered_rows": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders",
    "z_order_files": "SELECT 64::BIGINT AS files, true AS sort_reads_all, true AS z_order_prunes_second, true AS z_order_prunes_first",
    "packed_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "packed_files": "SELECT 12::BIGINT AS files_rewritten, 1::BIGINT AS files_written, 1::BIGINT AS files_kept, count(*) FILTER (o_orderkey % 4 <> 0) AS rows_kept, count(*) FILTER (o_orderkey % 4 = 0) AS rows_rewritten FROM orders",
    "compact_rows": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "table_detail": "SELECT 3::BIGINT AS num_files, (SELECT count(*) FROM orders) AS rows, true AS has_bytes",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
