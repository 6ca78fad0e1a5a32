"""DuckDB SQL of the queries in ``catalog``."""

from __future__ import annotations

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_ITEM = f"l_orderkey, {_ORDER}"
_EVENT = "PARTITION BY user_id ORDER BY ts, event_id"


def _hms(s: str, first: str) -> str:
    return f"printf('{first}', CAST(floor({s} / 3600) AS BIGINT), CAST(floor({s} / 60) AS BIGINT) % 60, CAST(floor({s}) AS BIGINT) % 60)"


def _rows(columns: str, *rows: str) -> str:
    """Expected rows of a query on literal texts."""
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


_BASE_EXPR = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"

ORACLE_SQL = {
    "q01_stream_select": """
        SELECT name, group_id, codecs, segments_count, bandwidth, stream_idx FROM (
          SELECT p_name AS name, p_brand AS group_id, p_type AS codecs, p_size AS segments_count, p_retailprice AS bandwidth, p_partkey AS stream_idx,
                 row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n
          FROM part WHERE regexp_matches(p_name, '^(large|small|cold)') AND regexp_matches(p_type, 'ECONOMY|PROMO|LARGE') AND regexp_matches(p_brand, 'Brand')
            AND p_size BETWEEN 5 AND 45 AND p_retailprice BETWEEN 901 AND 100000)
        WHERE r = CASE WHEN n <= 2 THEN 1 ELSE 2 END""",
    "q02_stream_worst": """
        SELECT group_id, codecs, stream_idx, bandwidth FROM (
          SELECT p_brand AS group_id, p_type AS codecs, p_partkey AS stream_idx, p_retailprice AS bandwidth,
                 row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_type) AS n
          FROM part WHERE p_retailprice >= 1)
        WHERE r = CASE WHEN n <= 3 THEN n ELSE n - 2 END""",
    "q02b_auto_select": """
        SELECT group_id, stream_idx, codecs, bandwidth FROM (
          SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY bandwidth DESC, stream_idx) AS r FROM (
            SELECT p_brand AS group_id, p_partkey AS stream_idx, p_type AS codecs, p_retailprice AS bandwidth, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part)
          WHERE stream_idx = f OR codecs IN ('ECONOMY', 'PROMO')) WHERE r = 1""",
    "q03_segment_clock": f"""
        SELECT {_ITEM}, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_time FROM lineitem""",
    "q03b_totals": "SELECT l_orderkey, sum(l_quantity) AS total_duration, count(*) AS segments_count FROM lineitem GROUP BY l_orderkey",
    "q03c_clock_reset": f"""
        WITH g AS (SELECT *, CASE WHEN l_discount = 0.1 AND l_partkey > 0 THEN l_partkey END AS t FROM lineitem),
        h AS (SELECT *, sum(CASE WHEN t IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS grp FROM g)
        SELECT {_ITEM}, CAST(coalesce(max(t) OVER w, 0) + coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey, grp ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start_time
        FROM h WINDOW w AS (PARTITION BY l_orderkey, grp ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)""",
    "q04_carry_forward": f"""
        WITH a AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS current_key, count(*) FILTER (event_type = 'view') OVER w AS n
                   FROM events WINDOW w AS ({_EVENT} ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id % 100 END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN event_type = 'signup' THEN n END IGNORE NULLS) OVER w AS bn
              FROM a WINDOW w AS ({_EVENT} ROWS UNBOUNDED PRECEDING))
        SELECT event_id, user_id, event_type, current_key, coalesce(b, 0) + n - coalesce(bn, 0) - 1 AS media_index FROM b""",
    "q05_run_expand": f"""
        WITH x AS (SELECT l.*, unnest(range(0, l_linenumber + 1)) AS rep FROM lineitem l),
        y AS (SELECT l_orderkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}, rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM x)
        SELECT l_orderkey, count(*) AS n, max(a) AS last_at, sum(a) AS sum_at FROM y GROUP BY l_orderkey""",
    "q06_run_encode": f"""
        WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER ({_EVENT}) = event_type THEN 0 ELSE 1 END AS new FROM events),
        b AS (SELECT *, sum(new) OVER ({_EVENT} ROWS UNBOUNDED PRECEDING) AS run FROM a)
        SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM b GROUP BY ALL""",
    "q07_chunk_lookup": """
        SELECT c.user_id, c.event_id AS chunk, e.value FROM (SELECT * FROM events WHERE event_type = 'view') c
        ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') e ON c.user_id = e.user_id AND c.event_id >= e.event_id""",
    "q07b_chunk_offsets": f"""
        SELECT {_ITEM}, CAST(coalesce(sum(CAST(trunc(l_extendedprice) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset FROM lineitem""",
    "q08_interleave": """
        WITH r AS (SELECT user_id, event_id, event_type = 'click' AS is_b, CAST(trunc(value * 100) AS BIGINT) AS pts, length(props) AS size FROM events WHERE event_type IN ('view', 'click')),
        t AS (SELECT *, max(pts) OVER (PARTITION BY user_id, is_b ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM r)
        SELECT user_id, event_id, is_b, row_number() OVER w AS place,
               CAST(48 + coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY t, is_b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, is_b, event_id)""",
    "q09_alternate": """
        WITH t AS (SELECT user_id, event_id, event_type = 'click' AS is_b, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events WHERE event_type IN ('view', 'click'))
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY turn, is_b) AS sequence FROM t""",
    "q10_first_of_key": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "q11_pending": """
        SELECT p_partkey AS task_id, pos FROM (SELECT p_partkey, unnest(range(0, 8)) AS pos FROM part)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = pos)""",
    "q12_key_attach": f"SELECT {_ITEM}, CASE WHEN s_acctbal >= 0 THEN md5(s_name) END AS key_hex FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "q13_progress": """
        WITH e AS (SELECT user_id AS task_id, CAST(floor(value * 100) AS BIGINT) AS bytes, ts AS a FROM events),
        t AS (SELECT task_id, count(*) + max(task_id) % 5 AS segments, min(a) AS started, sum(bytes) AS downloaded, count(*) AS segments_done,
                     sum(bytes) FILTER (a >= TIMESTAMP '2024-03-01' - INTERVAL 20 DAY) AS recent, min(a) FILTER (a >= TIMESTAMP '2024-03-01' - INTERVAL 20 DAY) AS oldest FROM e GROUP BY task_id),
        u AS (SELECT *, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(started)) / 1e6 AS elapsed, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(oldest)) / 1e6 AS since,
                     CAST(CASE WHEN task_id % 2 = 0 THEN segments * 30000 ELSE floor(downloaded / segments_done * segments) END AS BIGINT) AS total FROM t),
        v AS (SELECT *, CAST(floor(downloaded / elapsed) AS BIGINT) AS avg_speed, CAST(CASE WHEN recent > 0 AND since > 0 THEN floor(recent / since) ELSE 0 END AS BIGINT) AS speed FROM u)
        SELECT task_id, CAST(downloaded AS BIGINT) AS downloaded, total, segments_done, segments, round(elapsed, 6) AS elapsed, avg_speed, speed,
               round(CASE WHEN total > 0 THEN least(downloaded / total * 100, 100) ELSE segments_done / segments * 100 END, 6) AS percent,
               round(CASE WHEN total > 0 AND speed > 0 THEN (total - downloaded) / speed ELSE 0 END, 6) AS eta FROM v""",
    "q14_trailing": """
        SELECT event_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS recent, epoch_us(ts) - epoch_us(min(ts) OVER w) AS span_us
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
    "q15_split_ranges": """
        SELECT doc_id, n_chars, part, part * e AS start, CASE WHEN part = c - 1 THEN n_chars - 1 ELSE (part + 1) * e - 1 END AS "end" FROM (
          SELECT doc_id, n_chars, CASE WHEN n_chars < 4 THEN n_chars ELSE n_chars // 4 END AS e, CASE WHEN n_chars < 4 THEN 1 ELSE 4 END AS c,
                 unnest(range(0, CASE WHEN n_chars < 4 THEN 1 ELSE 4 END)) AS part FROM documents)""",
    "q16_ordered_concat": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "q16b_binary_concat": "SELECT conv_id, md5('init' || string_agg(text, '' ORDER BY turn)) AS md5, strlen('init' || string_agg(text, '' ORDER BY turn)) AS n_bytes FROM conversations GROUP BY conv_id",
    "q16c_srt": """
        WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, (turn * 1234567 + 2000000 + 500) // 1000 AS a, ((turn + 1) * 1234567 + 2000000 + 500) // 1000 AS b FROM conversations)
        SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg(printf('%d', n) || chr(10) || printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> '
          || printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS body FROM c GROUP BY conv_id""",
    "q17_addresses": f"""
        SELECT page_id, {_BASE_EXPR} AS base, regexp_replace(url, '[^/]*$', '') || 'seg.m4s' AS relative, regexp_extract(url, '^(.*?://[^/]*)', 1) || '/abs/seg.m4s' AS absolute, url AS empty,
               regexp_replace(url, '/+$', '') || '/QualityLevels(' || page_id || ')/Fragments(video=' || page_id * 10 || ')' AS fragment, 'https://other.example.org/x' AS passed FROM pages""",
    "q18_formats": f"""
        WITH x AS (SELECT *, l_extendedprice * 5000 AS n, l_partkey AS e, l_extendedprice / 10 AS d, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS b,
                          CAST(floor((CAST(trunc(l_extendedprice * 1000000) AS BIGINT) + 500) / 1000) AS BIGINT) AS ms FROM lineitem)
        SELECT {_ITEM},
          CASE WHEN n >= 1073741824 THEN printf('%.2fGB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.2fMB', n / 1048576) WHEN n >= 1024 THEN printf('%.2fKB', n / 1024) ELSE printf('%.2fB', n) END AS size_text,
          CASE WHEN e <= 0 OR e > 36000 THEN '--m--s' WHEN e >= 3600 THEN {_hms("e", "%02dh%02dm%02ds")} ELSE printf('%02dm%02ds', e // 60 % 60, e % 60) END AS eta_text,
          CASE WHEN d <= 0 THEN '0s' WHEN d >= 3600 THEN {_hms("d", "%dh%02dm%02ds")} WHEN d >= 60 THEN printf('%dm%02ds', CAST(floor(d / 60) AS BIGINT) % 60, CAST(floor(d) AS BIGINT) % 60) ELSE printf('%ds', CAST(floor(d) AS BIGINT)) END AS duration_text,
          CASE WHEN l_extendedprice * 100 >= 1000000 THEN printf('%.1f Mbps', l_extendedprice * 100 / 1000000) ELSE printf('%.0f Kbps', l_extendedprice * 100 / 1000) END AS bandwidth,
          CASE WHEN b >= 1000000 THEN printf('%.1f Mbps', b / 1000000) ELSE printf('%d Kbps', b // 1000) END AS bandwidth_short,
          printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock
        FROM x""",
    "q19_pts_bits": """
        SELECT o_orderkey, pts, printf('%02X%02X%02X%02X%02X', 32 + ((pts >> 30) & 7) * 2 + 1, (pts >> 22) & 255, ((pts >> 15) & 127) * 2 + 1, (pts >> 7) & 255, (pts & 127) * 2 + 1) AS packed, pts AS unpacked
        FROM (SELECT o_orderkey, o_orderkey * 104729 % 8589934592 AS pts FROM orders)""",
    "q20_overlay": """
        WITH x AS (SELECT user_id, arg_min(props, (ts, event_id)) AS a, arg_max(props, (ts, event_id)) AS b, count(*) AS n FROM events GROUP BY user_id)
        SELECT user_id, coalesce(json_extract_string(b, '$.k'), json_extract_string(a, '$.k')) AS k, CAST(n AS VARCHAR) AS only_base FROM x""",
    "q21_hls_streams": _rows(
        "manifest_id, stream_idx, media_type, group_id, language, name, bandwidth, codecs, resolution, frame_rate, url",
        "('master', 0::INT, 'audio', 'aud', 'en', 'English', 0::BIGINT, '', '', 0::DOUBLE, 'https://example.com/path/audio/en.m3u8')",
        "('master', 1, 'subtitles', 'sub', 'de', 'Deutsch, voll', 0, '', '', 0, 'https://example.com/subs/de.m3u8')",
        "('master', 2, 'video', '', '', '', 800000, 'avc1.4d401e,mp4a.40.2', '640x360', 25, 'https://example.com/path/low/video.m3u8')",
        "('master', 3, 'video', '', '', 'full', 5000000, 'avc1.640028', '1920x1080', 0, 'https://cdn.example.org/high.m3u8?x=1')",
    ),
    "q21b_hls_segments": _rows(
        "manifest_id, pos, seg_index, duration_s, url, range_start, range_len, method, key_url, iv",
        "('media', 0::INT, 5::BIGINT, 9.5::DOUBLE, 'https://example.com/path/a.ts', NULL::BIGINT, NULL::BIGINT, 'AES-128', 'https://example.com/path/keys/one.bin', '00000000000000000000000000000005')",
        "('media', 1, 6, 8, 'https://example.com/b.ts', 512, 1024, 'AES-128', 'https://example.com/path/keys/one.bin', '00000000000000000000000000000006')",
        "('media', 2, 0, 0, 'https://example.com/path/c.ts', NULL, NULL, '', '', NULL)",
        "('media', 3, 100, 2.25, 'https://example.com/path/d.ts', NULL, NULL, 'NONE', '', NULL)",
        "('live', 0, 901, 2.5, 'https://example.com/path/parts/first.m4s', NULL, NULL, '', '', NULL)",
        "('live', 1, 902, 3, 'https://example.com/path/parts/second.m4s', 0, 77, '', '', NULL)",
        "('live', 2, 903, 1.25, 'https://edge.example.net/third.m4s', NULL, NULL, '', '', NULL)",
    ),
    "q21c_hls_playlists": _rows(
        "manifest_id, is_live, refresh_ms, total_duration_s, target_duration_s, init_url, init_len",
        "('media', false, 0::DOUBLE, 19.75::DOUBLE, 10::DOUBLE, 'https://example.com/path/init.mp4', 800::BIGINT)",
        "('live', true, 3000, 6.75, 3, NULL, NULL)",
    ),
    "q22_dash_segments": _rows(
        "stream_idx, pos, seg_index, duration_s, url",
        *(f"({0}::INT, {i}::INT, {3 + i}::BIGINT, 20::DOUBLE, 'https://example.com/d/v//{3 + i}.m4s')" for i in range(4)),
        *(f"(1, {i}, {1 + i}, {d}, 'https://example.com/d/t_{t}_{1 + i}.m4s')" for i, (t, d) in enumerate([(9000, 1), (99000, 1), (189000, 1), (279000, 0.5), (900000, 1)])),
        "(2, 0, 1, 5, 'https://example.com/d/a1.m4s')", "(2, 1, 2, 5, 'https://example.com/x/a2.m4s')",
    ),
    "q22b_dash_streams": _rows(
        "stream_idx, media_type, language, name, bandwidth, resolution, frame_rate, url, segments_count",
        "(0::INT, 'video', 'en', 'v1', 3000000::BIGINT, '1280x720', 29.97::DOUBLE, 'https://example.com/d/m.mpd', 4::BIGINT)",
        "(1, 'video', 'en', '', 900000, 'unknown', 0, 'https://example.com/d/m.mpd', 5)",
        "(2, 'audio', 'fr', 'l', 128000, '', 0, 'https://example.com/abs/', 2)",
        "(3, 'audio', 'fr', 'single', 64000, '', 0, 'https://example.com/d/m.mpd', 0)",
    ),
    "q22c_mss_segments": _rows(
        "stream_idx, pos, duration_s, url",
        *(f"({k}::INT, {i}::INT, 1.1::DOUBLE, 'https://example.com/v.ism/QualityLevels({b})/Fragments(tal={i * 11000000})')" for k, b in enumerate((56000, 24000)) for i in range(7)),
        *(f"(2, {i}, {d}, 'https://example.com/v.ism/QualityLevels(310000)/Fragments(bild={t})')" for i, (t, d) in enumerate([(0, 1.5), (33000000, 0.5), (38000000, 0.1)])),
    ),
    "q22d_mss_streams": _rows(
        "stream_idx, media_type, language, name, bandwidth, codecs, resolution, channels, segments_count",
        "(0::INT, 'audio', 'sv', 'tal', 56000::BIGINT, 'aach', '', '6', 7::BIGINT)",
        "(1, 'audio', 'sv', 'tal', 24000, 'xyz9', '', '', 7)",
        "(2, 'video', '', 'bild_270p', 310000, 'hvc1', '480x270', '', 3)",
    ),
    "q23_cues": _rows(
        "doc_id, pos, id, start_us, end_us, text, settings",
        "('vtt', 0::INT, 'intro', 1000000::BIGINT, 2500000::BIGINT, 'Hello' || chr(10) || 'there', 'middle')",
        "('vtt', 1, '', 65250000, 3600000000, 'Last', '')",
        "('ttml', 0, '', 1500000, 2000000, 'One line', '')",
        "('ttml', 1, '', 1000000, 2000000, 'Two' || chr(10) || 'lines', '')",
        "('ttml', 2, '', 2500000, 3500000, 'Three', '')",
    ),
    "q24_live_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "q25_aes_round_trip": "SELECT doc_id, md5(text) AS cbc, md5(text) AS ecb, md5(text) AS ctr, CASE WHEN text IS NOT NULL THEN text <> '' END AS changed FROM documents",
    "q26_boxes": """
        WITH b AS (SELECT doc_id, strlen(text) AS n FROM documents)
        SELECT doc_id, x.path, x.depth, x.pos, x.size, x.offset FROM (
          SELECT doc_id, unnest([{'path': 'ftyp', 'depth': 0::INT, 'pos': 0::INT, 'size': 12::BIGINT, 'offset': 0::BIGINT}, {'path': 'moov', 'depth': 0, 'pos': 1, 'size': n + 32, 'offset': 12},
            {'path': 'moov/trak', 'depth': 1, 'pos': 2, 'size': n + 16, 'offset': 20}, {'path': 'moov/trak/free', 'depth': 2, 'pos': 3, 'size': n + 8, 'offset': 28},
            {'path': 'moov/udta', 'depth': 1, 'pos': 4, 'size': 8, 'offset': n + 36}]) AS x FROM b)""",
    "q27_display": """
        WITH p AS (SELECT *, CAST(trunc(p_retailprice * 1000) AS BIGINT) AS b FROM part),
        q AS (SELECT *, CASE WHEN b >= 1000000 THEN printf('%.1f Mbps', b / 1000000) ELSE printf('%d Kbps', b // 1000) END AS bw, ' | ' || p_size || CASE WHEN p_size = 1 THEN ' Segment' ELSE ' Segments' END AS seg FROM p)
        SELECT p_partkey AS stream_idx,
          CASE p_type WHEN 'PROMO' THEN 'Aud ' || p_brand || ' | ' || bw || ' | ' || p_name || ' | PROMO | 2' WHEN 'SMALL' THEN 'Sub ' || p_brand || ' | ' || p_name || ' | SMALL' ELSE 'Vid ' || bw || ' | ' || p_brand || ' | 25 | ' || p_type END || seg AS "full",
          CASE p_type WHEN 'PROMO' THEN 'Aud ' || bw || ' | ' || p_name || ' |  | ' WHEN 'SMALL' THEN 'Sub  | ' || p_name || ' | ' ELSE 'Vid  | ' || bw || ' | 25 | ' || p_type || ' | ' END AS short FROM q""",
    "q28_listing": """
        WITH p AS (SELECT p_brand AS manifest_id, p_partkey AS stream_idx, p_name AS language, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END AS b FROM part),
        q AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY b, stream_idx) AS place, row_number() OVER (PARTITION BY manifest_id, b, language ORDER BY stream_idx) AS l FROM p)
        SELECT manifest_id, stream_idx, place, place = 1 AS is_default, b = 1 AND l = 1 AS first_of_language FROM q""",
    "q29_durations": f"""
        WITH a AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS pts FROM events),
        b AS (SELECT *, lead(pts) OVER ({_EVENT}) - pts AS step FROM a),
        c AS (SELECT *, CASE WHEN step > 0 THEN step WHEN step IS NOT NULL THEN 3600 END AS d FROM b)
        SELECT event_id, CAST(coalesce(d, lag(d) OVER ({_EVENT}), 3600) AS BIGINT) AS duration FROM c""",
    "q30_key_indexes": f"""
        SELECT user_id, event_id, index FROM (
          SELECT *, row_number() OVER ({_EVENT}) AS index, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id) AS any_ FROM events) WHERE event_type = 'purchase' OR NOT any_""",
    "q31_movie_duration": """
        WITH a AS (SELECT user_id, event_type, event_id, CAST(floor(value * 100) AS BIGINT) AS pts, strlen(props) AS n FROM events),
        t AS (SELECT user_id, event_type, arg_max(pts, event_id) - arg_min(pts, event_id) + 3600 AS d, count(*) AS c, sum(n) AS bytes FROM a GROUP BY ALL)
        SELECT user_id, max(CASE WHEN d < 0 THEN c * 3600 ELSE d END) AS duration, CAST(sum(bytes) AS BIGINT) AS bytes FROM t GROUP BY user_id""",
    "q32_config": "SELECT event_id, CAST(user_id % 9 AS INT) AS thread_num, 3::INT AS retry_count, 'ts2mp4' AS merge, json_extract_string(props, '$.k') AS k FROM events",
    "q33_byte_ranges": """
        WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN encode(text)[doc_id % 50 + 1 : doc_id % 50 + 200] ELSE encode(text)[doc_id % 50 + 1 :] END AS b FROM documents)
        SELECT doc_id, md5(b) AS md5, octet_length(b) AS n FROM d""",
    "q34_format_sniff": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'hls' WHEN page_id % 3 = 1 THEN 'dash' WHEN page_id % 2 = 0 THEN 'mss' ELSE 'hls' END AS format FROM pages",
    "q35_scalars": """
        SELECT event_id, event_id % 5 * 3600.0::DOUBLE + event_id % 61 * 60.0::DOUBLE + event_id % 7 + 0.5::DOUBLE AS iso,
          CASE WHEN event_id % 2 = 1 THEN round((event_id % 60 * 1000) / 1001::DOUBLE, 6) END AS rate,
          CASE WHEN event_id % 2 = 0 THEN event_id * 2 ELSE 0 END AS range_start, (event_id % 60 * 60 + event_id % 59) * 1000000 + 250000 AS vtt_us,
          CAST(CASE event_id % 4 WHEN 0 THEN floor(event_id % 300 * 1000000 / 30) WHEN 1 THEN event_id % 300 WHEN 2 THEN event_id % 300 * 1000000 ELSE event_id % 300 * 1000 END AS BIGINT) AS ttml_us,
          CASE event_id % 3 WHEN 0 THEN 'avc1' WHEN 1 THEN 'mp4a.40.2' ELSE 'wvc1' END AS codec,
          CASE event_id % 4 WHEN 0 THEN event_id % 100 * 1024 WHEN 1 THEN event_id % 100 * 1048576 WHEN 2 THEN event_id % 100 ELSE 0 END AS speed,
          'seg_' || event_id || '.ts' AS file, (event_id % 4) * (event_id % 4) * 500 AS delay, '_' || event_id || '_' || event_id * 9 || '_90000' AS filled FROM events""",
}
