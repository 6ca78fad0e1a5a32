"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op6_byte_bpe
from .decontaminate import op8_decontamination
from .license_scan import OP5_SQL, op5_license_scans
from .line_dedup import op3_line_dedup
from .lm_scoring import OP1_SQL, op1_lm_scoring
from .ngram_join import op10_jaccard_join
from .quality_rules import op9_quality_rules
from .sharding import op2_sharding
from .suffix_dedup import op7_suffix_dedup
from .url_filters import OP4_SQL, op4_url_filters

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_license_scans": op5_license_scans,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
}


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
WITH bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ph AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS p
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dn AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM ph) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dp.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS p FROM dn) dp JOIN ph USING (n, p)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM d),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i, len(w) AS len FROM d),
g AS (
  SELECT doc_id, i, len, n, CASE n WHEN 5 THEN g5 WHEN 6 THEN g6 WHEN 8 THEN g8 ELSE g10 END AS p
  FROM (
    SELECT doc_id, i, len, string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g5, string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g6,
           string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g8, string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g10
    FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)), (VALUES (5), (6), (8), (10)) t(n)
  WHERE i + n <= len),
p AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, p) AS c FROM g),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM p WHERE c > 1),
s AS (
  SELECT doc_id, count(*) FILTER (n = 5) AS n_repeat_words, sum(length(word)) FILTER (n = 6) AS c6, sum(length(word)) FILTER (n = 8) AS c8, sum(length(word)) FILTER (n = 10) AS c10
  FROM c JOIN x USING (doc_id, i) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (
  SELECT doc_id, line, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS chars, count(*) OVER (PARTITION BY doc_id, line) AS c
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(chars) FILTER (c > 1) AS cl FROM k GROUP BY doc_id),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(c6, 0) / greatest(word_chars, 1)::DOUBLE AS cover_6, coalesce(c8, 0) / greatest(word_chars, 1)::DOUBLE AS cover_8,
         coalesce(c10, 0) / greatest(word_chars, 1)::DOUBLE AS cover_10, coalesce(cl, 0) / greatest(word_chars, 1)::DOUBLE AS cover_lines
  FROM b LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR cover_6 > 0.2 OR cover_8 > 0.2 OR cover_10 > 0.2 OR cover_lines > 0.3) AS kept FROM r
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (p) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN sz a ON a.doc_id = x JOIN sz b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT link.y, reach.r FROM reach JOIN link ON link.x = reach.doc_id)
SELECT doc_id, min(r) AS class_id, (SELECT count(*) FROM link WHERE x = reach.doc_id) AS n_links FROM reach GROUP BY doc_id
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, hash(b[i + 1:i + 200]) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d)),
r AS (
  SELECT doc_id, i, lag(i) OVER o AS p, lead(i) OVER o AS n FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p + 200 < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
run AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY ALL),
m AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last FROM run GROUP BY doc_id),
k AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM run
  UNION ALL SELECT doc_id, last, octet_length(b) FROM m JOIN d USING (doc_id)),
t AS (SELECT doc_id, string_agg(hex(b[x + 1:y]), '' ORDER BY x) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL = {
    "op1_lm_scoring": OP1_SQL,
    "op4_url_filters": OP4_SQL,
    "op5_license_scans": OP5_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_jaccard_join": OP10_SQL,
}
