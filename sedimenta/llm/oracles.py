"""DuckDB SQL with the results of the production queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROL, END, SEP, START
from .mixing import SLICE, TERMS
from .staging import UPPER

LOWER_TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
CODE_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_TEXT}, {BLANK_WORDS}) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
sizes AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, y AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
smallest AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT z.doc_id, z.n AS n_shingles, least(z.doc_id, coalesce(m.other, z.doc_id)) AS component_id,
  z.doc_id = least(z.doc_id, coalesce(m.other, z.doc_id)) AS kept
FROM sizes z LEFT JOIN smallest m ON m.doc_id = z.doc_id
"""


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), chr(92), chr(92) || chr(92))"
    for token in CONTROL:
        out = f"replace({out}, '{token}', '{token[0]}' || chr(92) || '{token[1:]}')"
    return out


OP3 = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text,
    {len(START) + len(SEP) + len(END)} + length({_escaped("role")}) + length({_escaped("text")}) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS dropped FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {BLANK_WORDS}) AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
spelled AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, {BLANK_WORDS}) GROUP BY doc_id),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram FROM w WHERE len(words) >= 5),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM often, range(5) r(j) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN spelled s ON s.doc_id = w.doc_id LEFT JOIN again a ON a.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM base
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY payload_digest, strlen(html)) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""

OP8 = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n_docs) FROM counts)::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE) / n_docs::DOUBLE AS rate FROM counts),
slices AS (SELECT *, greatest(0, ceil(rate / {SLICE}) - 1)::INTEGER AS n_full FROM rates),
parts AS (SELECT source, n_full, unnest([false, true]) AS is_full, unnest([rate - n_full * {SLICE}, {SLICE}]) AS rate FROM slices),
cdf AS (
  SELECT source, is_full, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM parts WHERE NOT is_full OR n_full > 0
  UNION ALL SELECT source, is_full, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM cdf WHERE k < {TERMS}),
places AS (
  SELECT d.*, n_full, unnest(range(0, n_full + 1)) AS part FROM documents d JOIN slices s ON s.source IS NOT DISTINCT FROM d.source),
drawn AS (
  SELECT *, ('0x' || substr(md5('17' || CASE WHEN part = 0 THEN '' ELSE '/' || part END || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM places),
numbered AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, row_number() OVER (PARTITION BY d.doc_id) - 1 AS k
  FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.is_full = (d.part < d.n_full) AND c.total <= d.u)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || k) AS shuffle_key FROM numbered
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_TEXT}, {CODE_WORDS}) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_TEXT}, {CODE_WORDS}) AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, unnest(list_transform(range(1, greatest(2, len(words) - 8)), lambda i: array_to_string(words[i:i + 9], ' '))) AS win
  FROM b WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS win
  FROM d, sizes WHERE len(words) >= n),
found AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON w.win = p.win AND w.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

#: The 256 remainders of the CRC-32 with the reversed polynomial 0xEDB88320, by rule.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text in UTF-8; ``t`` of ``crc_table`` has to be in reach."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"


OP11 = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents),
told AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc32("doc || ':' || run")} AS h FROM told, crc_table),
spoiled AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
picked AS (SELECT b.word, n_near, b.m, min(e.other) AS other FROM best b JOIN near e ON e.word = b.word AND e.m = b.m GROUP BY ALL),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN p.m >= 5 * w.n THEN other END AS form, CASE WHEN p.m >= 5 * w.n THEN p.m END AS form_n
  FROM words w LEFT JOIN picked p ON p.word = w.word),
chain AS (SELECT word, form AS up FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.up WHERE f.form IS NOT NULL),
ends AS (SELECT word, up AS root FROM chain c WHERE up NOT IN (SELECT word FROM forms WHERE form IS NOT NULL))
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON e.word = f.word
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {BLANK_WORDS}) AS words FROM documents),
places AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, unnest(list_transform(range(1, len(words) - 33), lambda i: sha256(array_to_string(words[i:i + 34], ' ')))) AS win FROM d WHERE len(words) >= 35),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM places) WHERE n > 1),
covered AS (SELECT DISTINCT r, i + j AS i FROM again, range(35) t(j)),
spelled AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT s.r, string_agg(s.word, ' ' ORDER BY s.i) AS kept FROM spelled s ANTI JOIN covered c ON c.r = s.r AND c.i = s.i GROUP BY s.r),
lost AS (SELECT r, count(*) AS n FROM covered GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost l ON l.r = d.r LEFT JOIN kept k ON k.r = d.r
"""

OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
parts AS (
  SELECT c.conv_id, 0 AS own, t.d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.d <= c.h
  UNION ALL SELECT c.conv_id, 1, t.d, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.d > c.h),
seqs AS (
  SELECT c.conv_id, coalesce(s.turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, d) AS turns FROM parts GROUP BY conv_id) s ON s.conv_id = c.conv_id),
prefixes AS (SELECT conv_id, d, turns[1:d] AS p, d = len(turns) AS last FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS parent, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * length(p[d].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN children c ON c.parent = n.p),
subtree AS (SELECT p[1:j] AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM told) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM told v JOIN subtree s ON s.top = v.p LEFT JOIN nodes u ON v.d > 0 AND u.p = v.p[1:v.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1, "op3_chat": OP3, "op5_line_dedup": OP5, "op6_rules": OP6, "op7_warc": OP7, "op8_mixing": OP8, "op10_decontaminate": OP10,
        "op11_spelling": OP11, "op12_substring_dedup": OP12, "op13_prefix_trie": OP13}
