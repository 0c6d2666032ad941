"""The same results in SQL for a row store, written from the definitions and not from the plans."""

from __future__ import annotations

_LINES = r"""b_lines AS (
  SELECT doc_id, page, i - 1 AS seq, line AS text, (72 + 14 * ((i - 1) // 2) + 20 * ((i - 1) // 8))::FLOAT AS y
  FROM (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_replace(line, '[\p{Z}\t-\r\x1c-\x1f]+', '', 'g') <> '')"""
_STYLE = _LINES + """, b_style AS (
  SELECT *, (12 + CASE WHEN seq % 9 = 0 THEN 4 ELSE 0 END)::FLOAT AS font_size, (page + seq) % 13 = 0 AS is_bold FROM b_lines)"""
_NOISE = _LINES + """, b_noise AS (
  SELECT doc_id, page, seq, text FROM b_lines
  UNION ALL SELECT source, doc_id, -4, 'Handbook ' || source FROM documents
  UNION ALL SELECT source, doc_id, -3, '2026/7/10 23:21' FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT source, doc_id, 900001, 'https://example.com/' || source FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT source, doc_id, 900002, (doc_id % 50 + 1) || '/50' FROM documents)"""


def _flags(rows: str, sample: str = "true") -> str:
    """CTEs t (trimmed rows) to flagged; titles come from rows under ``sample``."""
    return rf"""t AS (
  SELECT *, regexp_replace(text, '^[\p{{Z}}\t-\r\x1c-\x1f]+|[\p{{Z}}\t-\r\x1c-\x1f]+$', '', 'g') AS tt FROM {rows}
), titles AS (
  SELECT a.doc_id, a.tt AS title FROM t a
  JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM t WHERE {sample} GROUP BY 1) p USING (doc_id)
  WHERE a.tt <> '' AND length(a.tt) <= 60 AND {sample}
  GROUP BY a.doc_id, a.tt, p.pages
  HAVING count(DISTINCT a.page) >= 3 AND count(DISTINCT a.page) / p.pages >= 0.5
), lead AS (
  SELECT *, regexp_full_match(tt, 'https?://\S+') OR regexp_full_match(tt, '\d{{4}}/\d{{1,2}}/\d{{1,2}}\s+\d{{1,2}}:\d{{2}}(:\d{{2}})?')
         OR regexp_full_match(tt, 'https?://\S+\s+\d+/\d+') AS marks FROM t
), flagged AS (
  SELECT l.*, marks OR (regexp_full_match(tt, '\d+/\d+') AND bool_or(marks) OVER (PARTITION BY doc_id, page))
         OR EXISTS (SELECT 1 FROM titles x WHERE x.doc_id = l.doc_id AND x.title = l.tt) AS is_noise FROM lead l
)"""


_RUNS = """merged AS (
  SELECT doc_id, page, run, min(seq) AS seq, min(y) AS y, string_agg(text, ' ' ORDER BY seq) AS text, max(font_size) AS font_size,
         bool_or(is_bold) AS is_bold
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run
        FROM (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY seq)) < 0.01 THEN 0 ELSE 1 END AS fresh FROM {rows}))
  GROUP BY doc_id, page, run)"""
_SPACED = r"trim(regexp_replace({x}, '[\p{{Z}}\t-\r\x1c-\x1f]+', ' ', 'g'))"


def _paras(rows: str, scope: str) -> str:
    spaced = _SPACED.format(x="string_agg(text, ' ' ORDER BY seq)")
    return f"""{_RUNS.format(rows=rows)}, gapped AS (
  SELECT *, (y - lag(y) OVER (PARTITION BY {scope} ORDER BY page, seq))::FLOAT AS gap,
         lag(page) OVER (PARTITION BY {scope} ORDER BY page, seq) IS DISTINCT FROM page AS turn, count(*) OVER (PARTITION BY {scope}) AS n
  FROM merged
), medians AS (
  SELECT {scope}, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM gapped GROUP BY ALL
), islands AS (
  SELECT g.*, sum(CASE WHEN turn OR gap > (gaps[len(gaps) // 2 + 1] * 1.5::FLOAT)::FLOAT THEN 1 ELSE 0 END)
              OVER (PARTITION BY {scope} ORDER BY page, seq) - 1 AS para_idx
  FROM gapped g JOIN medians USING ({scope})
), paras AS (
  SELECT doc_id, page, para_idx::BIGINT AS para_idx, arg_min(y, seq)::DOUBLE AS top_y,
         CASE WHEN max(n) = 1 THEN min(text) ELSE {spaced} END AS text, max(font_size)::DOUBLE AS font_size, bool_or(is_bold) AS is_bold
  FROM islands GROUP BY doc_id, page, para_idx)"""


_HEADINGS = """base AS (
  SELECT doc_id, page, list_sort(list(font_size) FILTER (font_size > 0)) AS sizes FROM paras GROUP BY ALL
), headed AS (
  SELECT p.*, (font_size::FLOAT > (sizes[len(sizes) // 2 + 1]::FLOAT * 1.15::FLOAT)::FLOAT) OR is_bold AS is_heading FROM paras p JOIN base USING (doc_id, page))"""

_SEGMENTS = """items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS path_seq FROM lineitem
), b_segments AS (
  SELECT 1::BIGINT AS doc_id, l_orderkey AS page, path_seq, 0::BIGINT AS seg_seq, 50::FLOAT AS x1,
         (100 + 30 * l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 2000 ELSE 0 END)::FLOAT AS y1,
         (CASE WHEN l_suppkey % 7 = 0 THEN 60 ELSE 550 END)::FLOAT AS x2,
         (100 + 30 * l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 2000 ELSE 0 END)::FLOAT AS y2 FROM items
  UNION ALL SELECT 1, l_orderkey, path_seq, 1::BIGINT, (50 + 80 * l_linenumber)::FLOAT, 110::FLOAT, (50 + 80 * l_linenumber)::FLOAT, 400::FLOAT FROM items
), ruled AS (
  SELECT *, CASE WHEN abs(y2 - y1) <= 1.5 AND abs(x2 - x1) >= 15 THEN 'h' WHEN abs(x2 - x1) <= 1.5 AND abs(y2 - y1) >= 15 THEN 'v' END AS axis
  FROM b_segments WHERE x1 BETWEEN -1 AND 613 AND x2 BETWEEN -1 AND 613 AND y1 BETWEEN -1 AND 793 AND y2 BETWEEN -1 AND 793
), steps AS (
  SELECT page, axis, CASE WHEN v - lag(v) OVER (PARTITION BY page, axis ORDER BY v) > 3 THEN 1 ELSE 0 END AS step
  FROM (SELECT page, axis, CASE WHEN axis = 'h' THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS v FROM ruled WHERE axis IS NOT NULL)
), grids AS (
  SELECT page FROM (SELECT page, axis, 1 + sum(step) AS k FROM steps GROUP BY ALL) WHERE k >= 3 GROUP BY page HAVING count(*) = 2
), boxes AS (
  SELECT page, axis, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS x9, max(greatest(y1, y2)) AS y9
  FROM ruled WHERE axis IS NOT NULL GROUP BY ALL
), regions AS (
  SELECT 1::BIGINT AS doc_id, page, least(h.x0, v.x0) AS min_x, least(h.y0, v.y0) AS min_y, greatest(h.x9, v.x9) AS max_x, greatest(h.y9, v.y9) AS max_y
  FROM grids JOIN (SELECT * FROM boxes WHERE axis = 'h') h USING (page) JOIN (SELECT * FROM boxes WHERE axis = 'v') v USING (page)
  WHERE h.x0 <= v.x9 AND v.x0 <= h.x9 AND h.y0 <= v.y9 AND v.y0 <= h.y9)"""

_PATHS = """ops AS (
  SELECT 1::BIGINT AS doc_id, p_partkey // 4 AS page, p_partkey AS p, p_partkey % 4 AS e, p_partkey % 3 = 0 AS goes_on, p_size::FLOAT AS s, (p_partkey % 100)::FLOAT AS q FROM part
), ends AS (
  SELECT *, coalesce(sum(CASE WHEN goes_on THEN 1 ELSE 2 END) OVER (PARTITION BY page ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS path,
         lead(e) OVER (PARTITION BY page ORDER BY p) AS next_e FROM ops
), edges AS (
  SELECT doc_id, page, path AS path_seq, p * 10 + k AS k, 0 AS s, x1, y1, x2, y2, e <> 2 AS painted FROM ends,
    LATERAL (VALUES (1, s, 10, s + 100, 10), (3, s + 100, 200, s, 200), (4, s, 200, s, 10)) v(k, x1, y1, x2, y2)
  UNION ALL
  SELECT doc_id, page, path + 1, p * 10 + k, n, x1, y1, x2, y2, CASE WHEN goes_on THEN coalesce(next_e <> 2, false) ELSE true END FROM ends,
    LATERAL (VALUES (6, 0, q, s, q + 30, s), (6, 1, q + 30, s, q + 30, s + 20), (6, 2, q + 30, s + 20, q, s + 20), (6, 3, q, s + 20, q, s), (7, 0, q, s, 7, 8)) v(k, n, x1, y1, x2, y2))"""

_IMAGES = """b_images AS (
  SELECT 1::BIGINT AS doc_id, conv_id AS page, turn AS img_seq, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 19 ELSE 125 END AS width,
         1078 + CASE WHEN conv_id % 5 = 0 THEN turn % 2 ELSE 0 END AS height FROM conversations)"""

_OUTLINE = """RECURSIVE nodes AS (
  SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent, r_regionkey::BIGINT AS ord, r_name AS title,
         CASE WHEN r_regionkey <> 3 THEN r_regionkey * 7 + 1 END AS page, NULL::DOUBLE AS target_y FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_nationkey, n_name, n_nationkey + 1,
         CASE WHEN n_nationkey % 3 <> 0 THEN 792 - (692 - 10 * n_nationkey) END FROM nation
), walk AS (
  SELECT *, 0 AS depth, [ord * 1000 + id] AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.*, w.depth + 1, list_append(w.path, n.ord * 1000 + n.id) FROM nodes n JOIN walk w ON n.parent = w.id
), flat AS (
  SELECT 1::BIGINT AS doc_id, (row_number() OVER (ORDER BY path) - 1)::BIGINT AS entry_seq, title, page, depth, target_y FROM walk WHERE page IS NOT NULL
), parts AS (
  SELECT p_partkey AS para_idx, p_partkey // 7 AS page, ((p_partkey % 7) * 90 + p_size) AS top_y FROM part
), targets AS (
  SELECT f.*, coalesce(
    CASE WHEN target_y IS NOT NULL THEN (SELECT p.para_idx FROM parts p WHERE p.page = f.page ORDER BY abs(p.top_y - f.target_y), p.para_idx LIMIT 1) END,
    (SELECT min(para_idx) FROM parts p WHERE p.page >= f.page), (SELECT max(para_idx) FROM parts)) AS para_idx FROM flat f
), placed AS (
  SELECT s_suppkey, s_suppkey * 3 AS page, coalesce((SELECT max(para_idx) FROM parts p WHERE p.page <= s_suppkey * 3), -1) AS after_idx FROM supplier)"""

_W = r"[\p{Z}\t-\r\x1c-\x1f]+"
_C = "[中文测试页]"
_LD = "[A-Za-z0-9À-ɏ]"


def _twice(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"


_CJK = _twice(f"trim(regexp_replace(text, '{_W}', ' ', 'g'))", f"({_C}) ({_C})", r"\1\2")
_CJK = _twice(_twice(_CJK, f"({_C})({_LD})", r"\1 \2"), f"({_LD})({_C})", r"\1 \2")
_CJK_ROWS = _LINES + ", b_cjk AS (SELECT doc_id, page, seq, regexp_replace(translate(text, 'aeiou', '中文测试页'), '[^A-Za-z0-9À-ɏ 中文测试页]', '', 'g') AS text FROM b_lines)"

_DOCUMENT = _NOISE + ", styled AS (SELECT *, (72 + 14 * trunc(seq / 2) + 20 * trunc(seq / 8))::FLOAT AS y, 12::FLOAT AS font_size, false AS is_bold FROM b_noise WHERE NOT (page % 7 = 0 AND 72 + 14 * trunc(seq / 2) + 20 * trunc(seq / 8) BETWEEN 94 AND 206)), "
_DOCUMENT += _paras("styled", "doc_id") + ", " + _flags("paras")
_DOCUMENT += ", kept AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1)::BIGINT AS para_idx, page, top_y, text, font_size, is_bold FROM flagged WHERE NOT is_noise)"

_PAGE_BLOCKS = (
    _NOISE
    + ", styled AS (SELECT *, (72 + 14 * trunc(seq / 2) + 20 * trunc(seq / 8))::FLOAT AS y, 12::FLOAT AS font_size, seq = 1 AS is_bold FROM b_noise WHERE NOT (page % 7 = 0 AND 72 + 14 * trunc(seq / 2) + 20 * trunc(seq / 8) BETWEEN 94 AND 206)), "
    + _paras("styled", "doc_id, page")
    + f", {_HEADINGS}, {_flags('b_noise', 'page <= 150')}"
    + r""", pt AS (
  SELECT *, regexp_replace(text, '^[\p{Z}\t-\r\x1c-\x1f]+|[\p{Z}\t-\r\x1c-\x1f]+$', '', 'g') AS tt FROM headed
), pl AS (
  SELECT *, regexp_full_match(tt, 'https?://\S+') OR regexp_full_match(tt, '\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}(:\d{2})?')
         OR regexp_full_match(tt, 'https?://\S+\s+\d+/\d+') AS marks FROM pt
), pf AS (
  SELECT l.*, marks OR (regexp_full_match(tt, '\d+/\d+') AND bool_or(marks) OVER (PARTITION BY doc_id, page))
         OR EXISTS (SELECT 1 FROM titles x WHERE x.doc_id = l.doc_id AND x.title = l.tt) AS is_noise FROM pl l
), everything AS (
  SELECT doc_id, page, para_idx AS place, 0 AS rank, 'text' AS kind, text, is_heading, NULL AS image_ref FROM pf WHERE NOT is_noise AND (page % 10 <> 0 OR page % 7 = 0)
  UNION ALL SELECT source, doc_id, coalesce((SELECT max(para_idx) FROM pf WHERE NOT is_noise AND pf.doc_id = d.source AND pf.page = d.doc_id AND top_y < 100), -1), 1, 'image', NULL, false, 'table'
    FROM documents d WHERE doc_id % 7 = 0
  UNION ALL SELECT source, doc_id, 2147483647, 2, 'image', NULL, false, '0' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0)"""
)

EMPTY = "Nothing to show: no text and no images were found."
ERROR = "This document cannot be read."

#: Wrapping at 40. The lines hold no white space but spaces, no CJK and no word wider than a line, so cutting words is left to the unit tests.
_WRAP = r"""RECURSIVE widths AS (
  SELECT 0 AS n, 0::FLOAT AS other, 0::FLOAT AS space UNION ALL SELECT n + 1, (other + 0.55::FLOAT)::FLOAT, (space + 0.3::FLOAT)::FLOAT FROM widths WHERE n < 200
), known AS (SELECT list(other ORDER BY n) AS others, list(space ORDER BY n) AS spaces FROM widths), """ + _LINES + r""", words AS (
  SELECT doc_id, page, seq, list_transform(regexp_extract_all(text, ' +|[^ ]+'), lambda t: {
      't': t, 'used': CASE WHEN t[1] = ' ' THEN spaces[len(t) + 1] ELSE others[len(t) + 1] END, 'done': []::VARCHAR[]}) AS tokens FROM b_lines, known
), wrapped AS (
  SELECT doc_id, page, seq, list_reduce(list_prepend({'t': '', 'used': 0::FLOAT, 'done': []::VARCHAR[]}, tokens), lambda line, x: CASE
      WHEN x.t[1] = ' ' AND line.t = '' THEN line
      WHEN (line.used + x.used)::FLOAT <= 40 THEN {'t': line.t || x.t, 'used': (line.used + x.used)::FLOAT, 'done': line.done}
      WHEN x.t[1] = ' ' THEN {'t': '', 'used': 0::FLOAT, 'done': list_append(line.done, rtrim(line.t))}
      ELSE {'t': x.t, 'used': x.used, 'done': list_append(line.done, rtrim(line.t))} END) AS line FROM words
), every_line AS (
  SELECT doc_id, page, seq, CASE WHEN line.t <> '' OR len(line.done) = 0 THEN list_append(line.done, rtrim(line.t)) ELSE line.done END AS done FROM wrapped)"""

ORACLE_SQL: dict[str, str] = {
    "clean_lines": f"WITH {_NOISE}, {_flags('b_noise')} SELECT doc_id, page, seq, text FROM flagged WHERE NOT is_noise",
    "noise_lines": f"WITH {_NOISE}, {_flags('b_noise')} SELECT doc_id, page, seq, text FROM flagged WHERE is_noise",
    "learned_titles": f"WITH {_NOISE}, {_flags('b_noise', 'page <= 150')} SELECT doc_id, title FROM titles",
    "clean_lines_page_mode": f"WITH {_NOISE}, {_flags('b_noise', 'page <= 150')} SELECT doc_id, page, seq, text FROM flagged WHERE NOT is_noise",
    "merged_lines": f"WITH {_STYLE}, {_RUNS.format(rows='b_style')} SELECT doc_id, page, seq, y::DOUBLE AS y, text, font_size::DOUBLE AS font_size, is_bold FROM merged",
    "paragraphs_doc": f"WITH {_STYLE}, {_paras('b_style', 'doc_id')} SELECT * FROM paras",
    "paragraphs_page": f"WITH {_STYLE}, {_paras('b_style', 'doc_id, page')} SELECT * FROM paras",
    "headings": f"WITH {_STYLE}, {_paras('b_style', 'doc_id, page')}, {_HEADINGS} SELECT doc_id, page, para_idx, is_heading FROM headed",
    "cjk_spacing": f"WITH {_CJK_ROWS} SELECT doc_id, page, seq, {_CJK} AS spaced FROM b_cjk",
    "cjk_tokens": f"WITH {_CJK_ROWS} SELECT doc_id, page, seq, len(regexp_extract_all(text, '{_C}|{_W}|[^中文测试页 ]+')) AS n_tokens FROM b_cjk",
    "radical_fix": f"WITH {_LINES} SELECT doc_id, page, seq, translate(text, 'aeiou', '车长一人龙') AS fixed FROM b_lines",
    "grid_segments": f"WITH {_SEGMENTS} SELECT doc_id, page, path_seq, seg_seq, axis, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM ruled WHERE axis IS NOT NULL",
    "capped_segments": f"WITH {_SEGMENTS} SELECT doc_id, page, path_seq, seg_seq FROM b_segments WHERE path_seq * 2 <= 6",
    "table_regions": f"WITH {_SEGMENTS} SELECT doc_id, page, min_x::DOUBLE AS min_x, min_y::DOUBLE AS min_y, max_x::DOUBLE AS max_x, max_y::DOUBLE AS max_y FROM regions",
    "lines_outside_tables": f"""WITH {_SEGMENTS} SELECT 1::BIGINT AS doc_id, l_orderkey AS page, l_partkey AS seq, 'part ' || l_partkey AS text, (l_partkey % 792)::DOUBLE AS y
FROM lineitem l LEFT JOIN regions r ON r.page = l.l_orderkey
WHERE r.page IS NULL OR NOT (l_partkey % 792 BETWEEN 792 - max_y - 6 AND 792 - min_y + 6)""",
    "crop_rects": f"""WITH {_SEGMENTS}, r AS (
  SELECT doc_id, page, least(greatest(trunc((min_x - 6) * 2), 0), 1223) AS l, least(greatest(trunc((792 - max_y - 6) * 2), 0), 1583) AS t,
         trunc((max_x + 6) * 2) AS r, trunc((792 - min_y + 6) * 2) AS b FROM regions)
SELECT doc_id, page, l::BIGINT AS "left", t::BIGINT AS top, least(greatest(r, l + 1), 1224)::BIGINT AS "right", least(greatest(b, t + 1), 1584)::BIGINT AS bottom FROM r""",
    "strip_stitch": f"""WITH {_IMAGES}, s AS (SELECT page, list(width ORDER BY img_seq) AS w, list(height) AS h FROM b_images GROUP BY page)
SELECT 1::BIGINT AS doc_id, page, list_sum(w)::BIGINT AS width, h[1] AS height, len(w) AS n_strips FROM s
WHERE len(w) >= 3 AND len(list_distinct(h)) = 1 AND len(list_distinct(w[1:-2])) = 1 AND w[-1] <= w[1]""",
    "full_page_images": "SELECT 1::BIGINT AS doc_id, conv_id AS page, true AS has_image, conv_id % 3 = 0 AS has_full_page_image FROM conversations GROUP BY conv_id",
    "image_placement": f"WITH {_OUTLINE} SELECT 1::BIGINT AS doc_id, page, s_suppkey AS img_seq, after_idx FROM placed",
    "region_placement": """SELECT 1::BIGINT AS doc_id, s_suppkey * 2 AS page, (s_suppkey % 500)::DOUBLE AS top_y, s_suppkey, coalesce((
  SELECT max(p_partkey) FROM part WHERE p_partkey // 7 < s_suppkey * 2 OR (p_partkey // 7 = s_suppkey * 2 AND (p_partkey % 7) * 90 + p_size < s_suppkey % 500)), -1) AS after_idx
FROM supplier""",
    "outline_flat": f"WITH {_OUTLINE} SELECT doc_id, entry_seq, title, page::BIGINT AS page, depth::BIGINT AS depth, target_y FROM flat",
    "outline_targets": f"WITH {_OUTLINE} SELECT doc_id, entry_seq, title, page::BIGINT AS page, depth::BIGINT AS depth, target_y, para_idx FROM targets",
    "outline_blocks": f"WITH {_OUTLINE} SELECT doc_id, entry_seq, para_idx, para_idx + (SELECT count(*) FROM placed WHERE after_idx < t.para_idx) AS block_idx FROM targets t",
    "outline_labels": f"WITH {_OUTLINE} SELECT entry_seq, repeat(chr(12288), depth) || title AS label FROM flat",
    "blocks": f"""WITH {_STYLE}, {_paras('b_style', 'doc_id, page')}, {_HEADINGS}, everything AS (
  SELECT doc_id, page, para_idx AS place, 0 AS rank, 0 AS n, 'text' AS kind, text, is_heading, NULL AS image_ref FROM headed WHERE NOT (page % 10 = 0 AND page % 4 <> 0)
  UNION ALL SELECT source, doc_id, doc_id % 3 - 1, 1, 0, 'image', NULL, false, 'table' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT source, doc_id, 2147483647, 2, k, 'image', NULL, false, k::VARCHAR FROM documents, (VALUES (0), (1)) v(k) WHERE doc_id % 4 = 2)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY place, rank, n) - 1)::BIGINT AS block_idx, kind, text, is_heading, image_ref FROM everything""",
    "extract_document": f"WITH {_DOCUMENT} SELECT doc_id, para_idx, page, top_y, text, font_size, is_bold FROM kept",
    "document_images": f"""WITH {_DOCUMENT} SELECT source AS doc_id, doc_id AS page, 0::BIGINT AS kind,
  coalesce((SELECT max(para_idx) FROM kept k WHERE k.doc_id = d.source AND k.page <= d.doc_id), -1) AS after_idx FROM documents d WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0
UNION ALL SELECT source, doc_id, 1, coalesce((SELECT max(para_idx) FROM kept k WHERE k.doc_id = d.source AND (k.page < d.doc_id OR k.page = d.doc_id AND k.top_y < 100)), -1)
  FROM documents d WHERE doc_id % 7 = 0""",
    "reflow_lines": f"WITH {_WRAP} SELECT doc_id, page, seq, (i - 1)::BIGINT AS line_no, done[i] AS line FROM (SELECT *, unnest(range(1, len(done) + 1)) AS i FROM every_line)",
    "line_width": "SELECT p_partkey, CASE WHEN p_size - 5 <= 0 THEN 30 ELSE greatest(trunc(p_partkey * 3 / (p_size - 5)), 10) END::BIGINT AS chars FROM part",
    "subsampling": """SELECT p_partkey, (SELECT min(f) FROM (VALUES (1), (2), (4), (8), (16), (32), (64)) v(f)
  WHERE greatest(p_partkey * 17 % 70000 + 1, p_size * 91) // f <= 2000)::BIGINT AS factor FROM part""",
    "orientation": """SELECT p_partkey, m[1]::DOUBLE AS m00, m[2]::DOUBLE AS m01, m[3]::DOUBLE AS m10, m[4]::DOUBLE AS m11,
  (w / 2 - (m[1] * w / 2 + m[2] * w))::DOUBLE AS dx, (w - (m[3] * w / 2 + m[4] * w))::DOUBLE AS dy
FROM (SELECT p_partkey, p_size AS w, CASE p_partkey % 9 WHEN 1 THEN [-1, 0, 0, 1] WHEN 2 THEN [1, 0, 0, -1] WHEN 3 THEN [-1, 0, 0, -1]
  WHEN 4 THEN [0, -1, -1, 0] WHEN 5 THEN [0, -1, 1, 0] WHEN 6 THEN [0, 1, -1, 0] WHEN 7 THEN [0, 1, 1, 0] END AS m FROM part)""",
    "component_infer": """SELECT p_partkey, CASE WHEN bits NOT BETWEEN 1 AND 16 OR w <= 0 OR h <= 0 THEN -1
  WHEN reported = 3 AND ((w * 3 * bits + 7) // 8) * h = n THEN 3 WHEN ((w * bits + 7) // 8) * h = n THEN 1 WHEN ((w * 3 * bits + 7) // 8) * h = n THEN 3 ELSE -1 END::BIGINT AS components
FROM (SELECT p_partkey, p_size AS w, p_partkey % 11 AS h, p_partkey % 18 AS bits, p_partkey % 5 AS reported,
  ((p_size * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END * (p_partkey % 18) + 7) // 8) * (p_partkey % 11) AS n FROM part)""",
    "jpeg_components": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END::BIGINT AS components FROM part",
    "raw_decode": """SELECT p_partkey, upper(string_agg(repeat(substr(s, 2 * i + 1, 2), 3), '' ORDER BY i)) AS rgb,
  upper(string_agg(repeat(substr(s, 2 * (31 - ((i % 8) * 4 + i // 8)) + 1, 2), 3), '' ORDER BY i)) AS turned
FROM (SELECT p_partkey, sha256(p_partkey::VARCHAR) AS s FROM part), range(32) r(i) GROUP BY p_partkey""",
    "content_key": "SELECT doc_id, sha256(text) AS file_key FROM documents",
    "progress_upsert": """WITH u AS (SELECT user_id::VARCHAR AS k, arg_max(event_id % 7 - 1, event_id) AS page FROM events GROUP BY 1),
s AS (SELECT DISTINCT user_id::VARCHAR AS k FROM events)
SELECT k AS file_key, greatest(coalesce(u.page, 5), 1) AS page FROM s LEFT JOIN u USING (k) UNION ALL SELECT 'old' || k, 5 FROM s""",
    "progress_read": "SELECT DISTINCT user_id::VARCHAR AS file_key, CASE WHEN user_id % 2 = 0 THEN greatest(user_id % 9 - 2, 1) END AS page FROM events",
    "settings_clamp": """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 16 ELSE least(greatest(p_size, 12), 32) END::BIGINT AS font_size,
  least(greatest((p_size / 16)::FLOAT, 1), 2)::DOUBLE AS line_spacing, least(greatest(p_size - 10, 8), 32)::BIGINT AS padding,
  least(greatest(p_partkey % 60 - 10, 0), 32) AS block_spacing FROM part""",
    "load_state": f"""SELECT p_partkey, CASE WHEN good THEN 'success' ELSE 'error' END AS state, CASE WHEN good THEN p_size - 5 ELSE 0 END::BIGINT AS page_count,
  CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 3 = 2 THEN p_name ELSE '{ERROR}' END WHEN NOT good THEN '{EMPTY}' END AS message
FROM (SELECT *, p_partkey % 4 <> 0 AND p_size > 5 AND p_partkey % 7 <> 0 AS good FROM part)""",
    "slider_maps": """SELECT p_partkey, (floor((p_partkey % 101) / 100 * (p_size - 1) + 0.5) + 1)::BIGINT AS page,
  least(greatest(trunc(((p_size % 11) / 8)::FLOAT / 0.1::FLOAT), 0), 10)::BIGINT AS progress, spacing::DOUBLE AS spacing,
  least(greatest(trunc(((spacing - 1::FLOAT)::FLOAT / 0.1::FLOAT)::FLOAT), 0), 10)::BIGINT AS again
FROM (SELECT *, (1::FLOAT + ((p_size % 11)::FLOAT * 0.1::FLOAT)::FLOAT)::FLOAT AS spacing FROM part)""",
    "page_blocks": f"""WITH {_PAGE_BLOCKS} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY place, rank) - 1 AS block_idx, kind, text, is_heading, image_ref
FROM everything""",
    "single_page": f"""WITH {_PAGE_BLOCKS} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY place, rank) - 1 AS block_idx, kind, text, is_heading, image_ref
FROM everything WHERE page = 14""",
    "path_segments": f"""WITH {_PATHS} SELECT doc_id, page, path_seq::BIGINT AS path_seq, (row_number() OVER (PARTITION BY page, path_seq ORDER BY k, s) - 1)::BIGINT AS seg_seq,
  x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, painted FROM edges""",
    "painted_segments": f"""WITH {_PATHS} SELECT doc_id, page, path_seq::BIGINT AS path_seq, seg_seq FROM (
  SELECT *, (row_number() OVER (PARTITION BY page, path_seq ORDER BY k, s) - 1)::BIGINT AS seg_seq FROM edges) WHERE painted""",
    "glyph_lines": """SELECT 1::BIGINT AS doc_id, page, (row_number() OVER (PARTITION BY page ORDER BY y, x, k) - 1)::BIGINT AS seq, p_name AS text, y::DOUBLE AS y,
  (8 + least(n - 1, 4))::DOUBLE AS font_size, bold * 2 > n AS is_bold
FROM (SELECT p_partkey AS k, p_partkey // 20 AS page, p_partkey * 37 % 100 AS y, p_partkey % 3 * 100 AS x, p_name, len(p_name) AS n,
  CASE WHEN p_partkey % 11 = 0 THEN len(p_name) ELSE len(list_filter(range(len(p_name)), lambda i: (p_partkey + i) % 3 < p_partkey % 3)) END AS bold FROM part WHERE p_partkey % 13 <> 0)""",
    "strip_pixels": """WITH s AS (
  SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n, upper(sha256(conv_id || '-' || turn)) AS h FROM conversations
)
SELECT 1::BIGINT AS doc_id, conv_id AS page, 3 * n - 2 AS width, 2::BIGINT AS height, CASE WHEN conv_id % 5 = 0 AND min(turn) = 0 THEN 'none' ELSE
  string_agg(CASE WHEN last THEN h[1:6] ELSE h[1:18] END, '' ORDER BY turn) || string_agg(CASE WHEN last THEN h[7:12] ELSE h[19:36] END, '' ORDER BY turn) END AS pixels
FROM s WHERE n >= 3 GROUP BY conv_id, n""",
    "raw_depths": """WITH b AS (
  SELECT p_partkey, p_partkey % 16 + 1 AS bits, CASE WHEN p_partkey % 5 < 2 THEN 1 ELSE 3 END AS n,
         array_to_string(list_transform(string_split(sha256(p_partkey::VARCHAR), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS s FROM part
), v AS (
  SELECT p_partkey, bits, n, i, substr(s, (i // (2 * n)) * ((2 * n * bits + 7) // 8 * 8) + (i % (2 * n)) * bits + 1, bits) AS w FROM b, range(12) r(i) WHERE i < 4 * n
)
SELECT p_partkey, string_agg(repeat(printf('%02X', list_sum(list_transform(range(bits), lambda k: w[k + 1]::BIGINT << (bits - 1 - k)))::BIGINT * 255 // ((1 << bits) - 1)), CASE WHEN n = 1 THEN 3 ELSE 1 END),
  '' ORDER BY i) AS rgb FROM v GROUP BY p_partkey""",
    "page_status": "SELECT p_partkey, CASE WHEN p_partkey % 18 IN (7, 8) THEN 'ok' ELSE 'failed' END AS status FROM part",
    "decode_routes": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'raw'
  WHEN p_partkey % 2 = 0 AND greatest(p_partkey * 17 % 70000 + 1, p_size * 91) > 2000
       AND p_partkey % 5 = 3 THEN 'subsampled' ELSE 'library' END AS route FROM part""",
    "view_uris": "SELECT event_id, CASE WHEN upper(event_type) = 'VIEW' THEN props END AS uri FROM events",
}
