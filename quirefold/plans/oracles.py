"""Equivalent SQL of the core queries for DuckDB, written as state machines and windows of its own, not from the plans."""

from __future__ import annotations

from quirefold.functions import legacy
from quirefold.operators import classify

SP = r"\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SP}]"
#: An opening number with the first character after it: the pattern language has no look-ahead.
OPENER = f"^{WS}*([0-9]{{1,2}})(?:{WS}*[''.’]{WS}*[^{SP}]|[^{SP}0-9])"
MARKER = rf"\^{WS}*[1-5]{WS}*&|\({WS}*[1-5]{WS}*\)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def squeeze(x: str) -> str:
    return trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def opens(x: str) -> str:
    return f"regexp_matches({x}, '{OPENER}')"


def rest(x: str) -> str:
    return f"CASE WHEN {opens(x)} THEN substr({x}, length(regexp_extract({x}, '{OPENER}', 0))) ELSE {x} END"


def is_int(x: str) -> str:
    return f"regexp_matches({trim(x)}, '^[0-9]+$')"


NAME = "regexp_replace(font, '^[A-Z]{6}\\+', '')"


def coded(x: str) -> str:
    return f"coalesce(({NAME} IN ({', '.join(map(q, legacy.FONTS))}) OR regexp_matches({NAME}, '(?i)^FM')) AND NOT regexp_matches({x}, '[\\x{{0D80}}-\\x{{0DFF}}]'), false)"


TOKEN = "(?s)" + "|".join(t.replace(".", "\\.") for t in legacy.TOKENS if len(t) == 2) + "|."
MAP = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in legacy.TOKENS.items()) + "}"
PASSED = f"^[0-9\\-{SP}]$"
CONSONANT = "\\x{0D9A}-\\x{0DC6}"
PREFIX = "\\x{0DD9}\\x{0DDA}\\x{0DDB}"
CLUSTER = f"(?s)[{PREFIX}][^{CONSONANT}]*(?:[{CONSONANT}](?:\\x{{0DCA}}\\x{{200D}}[{CONSONANT}])*|\\z)|[^{PREFIX}]+"


def convert(x: str) -> str:
    toks = f"regexp_extract_all({x}, {q(TOKEN)}, 0)"
    mapped = f"array_to_string(list_transform({toks}, lambda t: coalesce({MAP}[t], CASE WHEN regexp_matches(t, {q(PASSED)}) THEN t ELSE {q(legacy.UNMAPPED)} END)), '')"
    moved = f"array_to_string(list_transform(regexp_extract_all({mapped}, '{CLUSTER}', 0), lambda s: regexp_replace(s, '[{PREFIX}]', '', 'g') || regexp_replace(s, '[^{PREFIX}]', '', 'g')), '')"
    for pair, sign in legacy.PAIRS:
        moved = f"replace({moved}, {q(pair)}, {q(sign)})"
    return f"regexp_replace(coalesce({moved}, ''), '([\\x{{0DCF}}-\\x{{0DDF}}])(\\x{{0DCA}}\\x{{200D}}[{CONSONANT}])', '\\2\\1', 'g')"


def unmapped(x: str) -> str:
    return f"len(list_filter(regexp_extract_all({x}, {q(TOKEN)}, 0), lambda t: {MAP}[t] IS NULL AND NOT regexp_matches(t, {q(PASSED)})))"


ITEMS = "items AS (SELECT DISTINCT ON (item_id) * FROM positioned_item WHERE item_id IS NOT NULL ORDER BY item_id, loaded_at)"
CONVERTED = f"conv AS (SELECT *, CASE WHEN {coded('str')} THEN {convert('str')} ELSE str END AS text, CASE WHEN {coded('str')} THEN {unmapped('str')} ELSE 0 END AS unmapped FROM items)"


def lines(source: str) -> str:
    """CTEs ending in `lines`, from converted fragments of that name; the first fragment of a line stays its anchor."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY session_id, page_index ORDER BY y DESC, item_idx, item_id) AS rn FROM {source}),
walk AS (
  SELECT *, y AS anchor, 0 AS line FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.*, CASE WHEN abs(w.anchor - o.y) <= 3 THEN w.anchor ELSE o.y END, CASE WHEN abs(w.anchor - o.y) <= 3 THEN w.line ELSE w.line + 1 END
  FROM walk w JOIN ordered o ON o.session_id = w.session_id AND o.page_index = w.page_index AND o.rn = w.rn + 1),
across AS (SELECT *, row_number() OVER l AS k, lag(text) OVER l AS before, lag(str) OVER l AS before_raw, first_value(text) OVER l AS first_text, first_value(str) OVER l AS first_raw FROM walk
  WINDOW l AS (PARTITION BY session_id, page_index, line ORDER BY x, y DESC, item_idx, item_id)),
joined AS (SELECT *,
  CASE WHEN k = 1 OR (k = 2 AND regexp_matches(first_text, '^[0-9]{{1,2}}$')) OR regexp_matches(before, '{WS}$') OR regexp_matches(text, '^{WS}') THEN '' ELSE ' ' END AS sep,
  CASE WHEN k = 1 OR (k = 2 AND regexp_matches(first_raw, '^[0-9]{{1,2}}$')) OR regexp_matches(before_raw, '{WS}$') OR regexp_matches(str, '^{WS}') THEN '' ELSE ' ' END AS sep_raw FROM across),
lines AS (SELECT session_id, page_index, line::INTEGER AS line_idx, string_agg(sep || text, '' ORDER BY k) AS text, string_agg(sep_raw || str, '' ORDER BY k) AS raw,
  max(y) AS y, min(x) AS x, max(x + coalesce(w, 0)) - min(x) AS w, max(coalesce(h, 0)) AS h, sum(unmapped)::BIGINT AS unmapped, count(*)::INTEGER AS items
  FROM joined GROUP BY session_id, page_index, line)"""


SEGMENTS = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id, page_index ORDER BY line_idx) AS rn, {opens('text')} AS opens FROM lines),
machine AS (
  SELECT session_id, page_index, line_idx, rn, opens, text, raw, x, y, w, h, unmapped, opens::INTEGER AS q, opens AS active, y AS prev, CAST([] AS DOUBLE[]) AS gaps FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.session_id, n.page_index, n.line_idx, n.rn, n.opens, n.text, n.raw, n.x, n.y, n.w, n.h, n.unmapped, m.q + n.opens::INTEGER,
    CASE WHEN n.opens THEN true WHEN NOT m.active THEN false WHEN regexp_matches({trim('n.text')}, '^[0-9]{{1,3}}$') THEN false
         WHEN len(m.gaps) > 0 AND m.prev - n.y > 2.5 * list_sort(m.gaps)[len(m.gaps) // 2 + 1] THEN false ELSE true END AS active,
    n.y, CASE WHEN n.opens THEN CAST([] AS DOUBLE[]) ELSE list_append(m.gaps, m.prev - n.y) END
  FROM machine m JOIN numbered n ON n.session_id = m.session_id AND n.page_index = m.page_index AND n.rn = m.rn + 1),
segs AS (SELECT * FROM machine WHERE active AND q > 0)"""

PARSED = f"""
cut AS (SELECT *, string_split_regex({rest('text')}, {q(MARKER)}) AS parts FROM segs),
plain AS (SELECT *, {trim('parts[1]')} AS before FROM cut),
pieces AS (
  SELECT session_id, page_index, q, line_idx, 0 AS n, 0 AS starts, before AS text FROM plain WHERE before <> '' OR (NOT opens AND len(parts) = 1)
  UNION ALL
  SELECT session_id, page_index, q, line_idx, n, 1, {trim('part')} FROM (SELECT session_id, page_index, q, line_idx, unnest(range(1, len(parts))) AS n, unnest(parts[2:]) AS part FROM plain)),
counted AS (SELECT *, sum(starts) OVER (PARTITION BY session_id, page_index, q ORDER BY line_idx, n) AS k FROM pieces),
built AS (SELECT session_id, page_index, q, k, string_agg(text, ' ' ORDER BY line_idx, n) AS text FROM counted GROUP BY ALL),
stems AS (SELECT session_id, page_index, q, {squeeze('text')} AS stem FROM built WHERE k = 0),
opts AS (SELECT session_id, page_index, q, list(text ORDER BY k) AS options FROM built WHERE k > 0 GROUP BY ALL),
heads AS (SELECT session_id, page_index, q, max(CASE WHEN opens THEN regexp_extract(text, '{OPENER}', 1)::INTEGER END) AS number, string_agg(raw, '' ORDER BY line_idx) AS raw_legacy,
  min(x) AS x, max(y) AS y, max(x + w) - min(x) AS w, max(y) - min(y - h) AS h, sum(unmapped)::BIGINT AS unmapped FROM segs GROUP BY ALL),
parsed AS (SELECT h.*, coalesce(s.stem, '') AS stem, o.options FROM heads h JOIN opts o USING (session_id, page_index, q) LEFT JOIN stems s USING (session_id, page_index, q))"""


def kind(stem: str, options: str, overlaps: str) -> str:
    letters = f"(?i)^[A-E](?:{WS}*(?:හා|යා|සහ|,|and)?{WS}*[A-E])*$"
    enum = f"(?s)(?:^|{WS})A{WS}+[^{SP}]+.*(?:^|{WS})B{WS}+[^{SP}]+"
    words = " OR ".join(f"contains({stem}, {q(w)})" for w in classify.FIGURE_WORDS)
    return f"""CASE WHEN coalesce(len({options}) NOT IN (4, 5), true) OR coalesce(len(list_filter({options}, lambda o: regexp_matches({trim('o')}, '{letters}'))) > 0, false) OR coalesce(regexp_matches({stem}, '{enum}'), false) THEN 'special'
      WHEN coalesce({words}, false) OR {overlaps} THEN 'figure' ELSE 'straight' END"""


def answers(source: str, row: float = 4) -> str:
    """CTEs ending in `labelled`, from fragments of that name."""
    return f"""
ints AS (SELECT session_id, page_index, item_idx, TRY_CAST({trim('str')} AS BIGINT) AS n, x, y FROM {source} WHERE {is_int('str')} AND x IS NOT NULL AND y IS NOT NULL AND TRY_CAST({trim('str')} AS BIGINT) IS NOT NULL),
seeds AS (SELECT session_id, page_index, x, row_number() OVER (PARTITION BY session_id, page_index ORDER BY x) AS rn FROM ints WHERE n >= 6),
cols AS (SELECT *, x AS anchor, 0 AS c FROM seeds WHERE rn = 1 UNION ALL
  SELECT s.*, CASE WHEN s.x - c.anchor <= 3 THEN c.anchor ELSE s.x END, CASE WHEN s.x - c.anchor <= 3 THEN c.c ELSE c.c + 1 END FROM cols c JOIN seeds s ON s.session_id = c.session_id AND s.page_index = c.page_index AND s.rn = c.rn + 1),
columns_ AS (SELECT DISTINCT session_id, page_index, c::INTEGER AS column_idx, anchor AS x FROM cols),
placed AS (SELECT i.*, EXISTS (SELECT 1 FROM columns_ c WHERE c.session_id = i.session_id AND c.page_index = i.page_index AND abs(c.x - i.x) <= 3) AS lab FROM ints i),
near AS (SELECT l.session_id, l.page_index, l.item_idx, a.n AS answer, row_number() OVER (PARTITION BY l.session_id, l.page_index, l.item_idx ORDER BY a.x - l.x, a.item_idx) AS r
  FROM placed l JOIN placed a ON l.lab AND NOT a.lab AND a.n BETWEEN 1 AND 5 AND a.session_id = l.session_id AND a.page_index = l.page_index AND abs(a.y - l.y) <= {row} AND a.x - l.x > 0 AND a.x - l.x <= 40),
labelled AS (SELECT l.session_id, l.page_index, l.item_idx, l.n AS label, n.answer FROM placed l LEFT JOIN near n ON n.session_id = l.session_id AND n.page_index = l.page_index AND n.item_idx = l.item_idx AND n.r = 1 WHERE l.lab)"""


KEY = "keyed AS (SELECT session_id, page_index, label, arg_max(answer, item_idx) AS answer FROM labelled WHERE answer IS NOT NULL GROUP BY ALL)"
LATEST = "latest AS (SELECT DISTINCT ON (session_id) * FROM exam_session WHERE session_id IS NOT NULL ORDER BY session_id, saved_at DESC, source_name DESC NULLS LAST)"
MARKS = f"marks AS (SELECT session_id, page_index, {trim('str')} AS text, count(*) AS n FROM items WHERE length({trim('str')}) >= 12 GROUP BY ALL HAVING count(*) >= 4)"
BARE = f"bare AS (SELECT * FROM conv c WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.session_id IS NOT DISTINCT FROM c.session_id AND m.page_index IS NOT DISTINCT FROM c.page_index AND m.text = {trim('c.str')}))"
STATS = f"""stats AS (SELECT session_id, page_index, count(*) AS items, count(*) FILTER ({trim('str')} IN ('^1&', '^2&', '^3&', '^4&')) AS markers, count(*) FILTER ({is_int('str')}) AS ints, count(*) FILTER ({is_int('str')}) / count(*) AS ratio FROM items GROUP BY ALL)"""
SHEETS = "sheet AS (SELECT i.* FROM items i JOIN latest s ON s.session_id = i.session_id AND NOT coalesce(s.has_no_answer_sheet, false) AND i.page_index = s.answer_page)"
QUESTIONS = "qs AS (SELECT DISTINCT ON (question_id) * FROM question ORDER BY question_id, loaded_at)"


def _w(*ctes: str, last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + last


def _numbered(o: str) -> str:
    return f"array_to_string(list_transform({o}, lambda o, i: '(' || i || ') ' || coalesce(o, '')), chr(10))"


def _export(stem: str, options: str) -> str:
    opts = f"coalesce({options}, CAST([] AS VARCHAR[]))"
    return f"""SELECT question_id, number, coalesce({stem}, '') || chr(10) || {_numbered(opts)} AS full_question, coalesce({stem}, '') AS question, {_numbered(opts)} AS answers,
      CASE WHEN coalesce(correct_answer, 0) > 0 THEN correct_answer || '. ' || coalesce({opts}[correct_answer], '') ELSE '' END AS correct_answer FROM qs WHERE kind = 'straight'"""


SPLIT_STEM = trim(f"string_split_regex({rest('raw_legacy')}, {q(MARKER)})[1]")
SPLIT_OPTIONS = f"list_transform(string_split_regex({rest('raw_legacy')}, {q(MARKER)})[2:], lambda o: {trim('o')})"
OVERLAP = "EXISTS (SELECT 1 FROM imgs i WHERE i.session_id = p.session_id AND i.page_index = p.page_index AND p.x < i.x + i.w AND i.x < p.x + p.w AND p.y - p.h < i.y AND i.y - i.h < p.y)"
IMAGES = "imgs AS (SELECT DISTINCT ON (region_id) * FROM image_region ORDER BY region_id, loaded_at)"
RAW = "raws AS (SELECT DISTINCT ON (rq_id) rq_id, session_id, page_index, stem, options, bbox.x AS x, bbox.y AS y, bbox.w AS w, bbox.h AS h FROM raw_question ORDER BY rq_id, loaded_at)"
SELECTED = "chosen AS (SELECT b.* FROM bare b JOIN latest s ON s.session_id = b.session_id AND (s.question_pages IS NULL OR list_contains(s.question_pages, b.page_index)))"
HOSTS = "hosts AS (SELECT doc_id, regexp_replace(lower(h), '\\.$', '') AS host FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, '') || ' https://' || coalesce(source, 'localhost') || '.net./a http://unpkg.com/' || doc_id, '(?i)https?://([a-z0-9.-]+)', 1)) AS h FROM documents) WHERE contains(regexp_replace(lower(h), '\\.$', ''), '.'))"

ORACLES = {
    "text_runs": _w(ITEMS, last=f"SELECT item_id, str, round(x, 1) AS x, round(y, 1) AS y, round(w, 1) AS w, round(h, 1) AS h, font FROM items WHERE {trim('str')} <> ''"),
    "watermarks": _w(ITEMS, MARKS, last="SELECT session_id, page_index, text, n FROM marks"),
    "watermark_strip": _w(ITEMS, MARKS, last=f"SELECT item_id, session_id, page_index, str FROM items c WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.session_id IS NOT DISTINCT FROM c.session_id AND m.page_index IS NOT DISTINCT FROM c.page_index AND m.text = {trim('c.str')})"),
    "page_stats": _w(ITEMS, STATS, last="SELECT * FROM stats"),
    "page_needs_ocr": _w(ITEMS, last="SELECT p.session_id, p.page_index, coalesce(n, 0) < 10 AS needs_ocr FROM (SELECT DISTINCT session_id, page_index FROM text_line) p LEFT JOIN (SELECT session_id, page_index, count(*) AS n FROM items GROUP BY ALL) c ON c.session_id = p.session_id AND c.page_index = p.page_index"),
    "suggest_question_pages": _w(ITEMS, STATS, last="SELECT session_id, page_index FROM stats WHERE markers >= 4 AND ratio < 0.2"),
    "suggest_answer_page": _w(ITEMS, STATS, last="SELECT session_id, page_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ratio DESC, page_index) AS r FROM stats WHERE ints >= 40 AND ratio >= 0.15) WHERE r = 1"),
    "ocr_clean": "SELECT DISTINCT ON (line_id) line_id, replace(text, chr(8204), '') AS text FROM text_line WHERE source = 'ocr' ORDER BY line_id, loaded_at",
    "ocr_to_points": f"SELECT line_id, replace(text, chr(8204), '') AS str, bbox.x / 2.0 AS x, (3000.0 - (bbox.y + bbox.h)) / 2.0 AS y, (bbox.x + bbox.w - bbox.x) / 2.0 AS w, (bbox.y + bbox.h - bbox.y) / 2.0 AS h, 'OCR' AS font FROM (SELECT DISTINCT ON (line_id) * FROM text_line WHERE source = 'ocr' ORDER BY line_id, loaded_at) WHERE {trim('replace(text, chr(8204), ' + q('') + ')')} <> ''",
    "font_tables": "SELECT font, " + NAME + " AS name, " + coded("'a'") + " AS is_legacy FROM (SELECT DISTINCT font FROM positioned_item WHERE font IS NOT NULL)",
    "distinct_fonts": "SELECT DISTINCT " + NAME + " AS font FROM positioned_item WHERE font IS NOT NULL",
    "legacy_convert": _w(ITEMS, CONVERTED, last="SELECT item_id, text, unmapped::BIGINT AS unmapped FROM conv"),
    "coverage_ratio": _w(ITEMS, CONVERTED, last="SELECT " + NAME + f" AS font, sum(length(str))::BIGINT AS characters, sum(unmapped)::BIGINT AS unmapped FROM conv WHERE {coded('str')} GROUP BY 1"),
    "line_groups": _w(ITEMS, CONVERTED, lines("conv"), last="SELECT session_id, page_index, line_idx, y, x, w, h, unmapped, items FROM lines"),
    "line_text": _w(ITEMS, CONVERTED, lines("conv"), last="SELECT session_id, page_index, line_idx, text, raw FROM lines"),
    "question_openers": f"SELECT line_id, regexp_extract(text, '{OPENER}', 1)::INTEGER AS number, {rest('text')} AS rest FROM (SELECT DISTINCT ON (line_id) * FROM text_line ORDER BY line_id, loaded_at) WHERE {opens('text')}",
    "question_segments": _w(ITEMS, CONVERTED, lines("conv"), SEGMENTS, last="SELECT session_id, page_index, line_idx, q::BIGINT AS q, opens FROM segs"),
    "question_parse": _w(ITEMS, CONVERTED, lines("conv"), SEGMENTS, PARSED, last="SELECT session_id, page_index, q::BIGINT AS q, number, stem, array_to_string(options, '|') AS options, x, y, w, h, raw_legacy, unmapped FROM parsed"),
    "legacy_split": _w(QUESTIONS, last=f"SELECT question_id, {SPLIT_STEM} AS stem, array_to_string({SPLIT_OPTIONS}, '|') AS options FROM qs WHERE raw_legacy IS NOT NULL"),
    "classify_questions": _w(RAW, IMAGES, last=f"SELECT rq_id, {kind('stem', 'options', OVERLAP)} AS kind FROM raws p"),
    "figure_overlap": _w(RAW, IMAGES, last=f"SELECT rq_id FROM raws p WHERE {OVERLAP}"),
    "label_columns": _w(ITEMS, LATEST, SHEETS, answers("sheet"), last="SELECT session_id, page_index, column_idx, x FROM columns_"),
    "answer_pairs": _w(ITEMS, LATEST, SHEETS, answers("sheet"), last="SELECT session_id, page_index, item_idx, label, answer FROM labelled"),
    "answer_key": _w(ITEMS, LATEST, SHEETS, answers("sheet"), KEY, last="SELECT session_id, page_index, label, answer FROM keyed"),
    "answer_unresolved": _w(ITEMS, LATEST, SHEETS, answers("sheet"), last="SELECT session_id, page_index, item_idx, label FROM labelled WHERE answer IS NULL"),
    "answer_unresolved_strict": _w(ITEMS, LATEST, SHEETS, answers("sheet", 0.25), last="SELECT session_id, page_index, item_idx, label FROM labelled WHERE answer IS NULL"),
    "valid_answers": _w(QUESTIONS, last="SELECT question_id, nullif(number, 7) AS typed FROM qs WHERE number IN (1, 2, 3, 4, 5, 7)  OR number IS NULL"),
    "export_gate": _w(ITEMS, LATEST, SHEETS, answers("sheet", 0.25), last="SELECT session_id, count(*) FILTER (answer IS NULL) AS unresolved, count(*) = count(answer) AS may_export, CASE WHEN count(*) = count(answer) THEN 'questions-legacy.xlsx' ELSE 'questions.xlsx' END AS file_name FROM labelled GROUP BY session_id"),
    "resolve_fonts": _w(ITEMS, last="SELECT item_id, coalesce(r.family, i.font) AS font FROM items i LEFT JOIN font_ref r ON r.font = i.font"),
    "item_files": _w(ITEMS, last="SELECT session_id, page_index, (row_number() OVER (PARTITION BY session_id, page_index ORDER BY item_idx) - 1)::INTEGER AS item_idx, str, x, y, w, h, font FROM items"),
    "recognise_isolated": "SELECT line_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'failed' ELSE 'ok' END AS status, CASE WHEN regexp_matches(text, '[0-9]') THEN 0 ELSE len(string_split(text, ' ')) END::INTEGER AS words FROM (SELECT DISTINCT ON (line_id) line_id, text FROM text_line WHERE source = 'ocr' ORDER BY line_id, loaded_at)",
    "answer_grid": _w(ITEMS, LATEST, SHEETS, answers("sheet"), last="SELECT session_id, greatest(40, max(label))::BIGINT AS cells FROM labelled GROUP BY session_id"),
    "assemble": _w(ITEMS, CONVERTED, MARKS, BARE, LATEST, SELECTED, SHEETS, lines("chosen"), SEGMENTS, PARSED, answers("sheet"), KEY, IMAGES, last=f"""
SELECT p.session_id, (SELECT CASE WHEN s.question_pages IS NULL THEN p.page_index ELSE list_position(s.question_pages, p.page_index) END::BIGINT FROM latest s WHERE s.session_id = p.session_id) AS page_pos, 'p' || p.page_index || '-q' || p.number AS id, p.page_index, p.q::BIGINT AS q, p.number, p.stem, array_to_string(p.options, '|') AS options, p.x, p.y, p.w, p.h, {kind('p.stem', 'p.options', OVERLAP)} AS kind,
  CASE WHEN p.unmapped > 0 THEN 'unmapped-glyph' ELSE '' END AS flags, k.answer::INTEGER AS correct_answer, p.raw_legacy, false AS edited
FROM parsed p LEFT JOIN keyed k ON k.session_id = p.session_id AND k.label = p.number"""),
    "assemble_scanned": _w(ITEMS, LATEST, SHEETS, answers("sheet"), KEY, IMAGES, f"""
scans AS (SELECT DISTINCT ON (line_id) session_id, page_index, line_id AS item_id, line_idx AS item_idx, replace(text, chr(8204), '') AS str, bbox.x AS x, y, bbox.w AS w, bbox.h AS h FROM text_line WHERE source = 'ocr' ORDER BY line_id, loaded_at),
few AS (SELECT DISTINCT session_id, page_index FROM scans EXCEPT SELECT session_id, page_index FROM items GROUP BY ALL HAVING count(*) >= 10),
taken AS (SELECT s.*, s.str AS text, 0 AS unmapped FROM scans s JOIN few USING (session_id, page_index)),
noise AS (SELECT session_id, page_index, {trim('str')} AS t FROM taken WHERE length({trim('str')}) >= 12 GROUP BY ALL HAVING count(*) >= 4),
chosen AS (SELECT b.* FROM taken b JOIN latest s ON s.session_id = b.session_id AND (s.question_pages IS NULL OR list_contains(s.question_pages, b.page_index))
  WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.session_id = b.session_id AND n.page_index = b.page_index AND n.t = {trim('b.str')}))""", lines("chosen"), SEGMENTS, PARSED, last=f"""
SELECT p.session_id, 'p' || p.page_index || '-q' || p.number AS id, p.page_index, p.q::BIGINT AS q, p.number, p.stem, array_to_string(p.options, '|') AS options, {kind('p.stem', 'p.options', OVERLAP)} AS kind, 'ocr' AS flags, k.answer::INTEGER AS correct_answer
FROM parsed p LEFT JOIN keyed k ON k.session_id = p.session_id AND k.label = p.number"""),
    "question_order": _w(ITEMS, CONVERTED, MARKS, BARE, LATEST, SELECTED, SHEETS, lines("chosen"), SEGMENTS, PARSED, last="""
SELECT p.session_id, p.number, CASE WHEN s.question_pages IS NULL THEN p.page_index ELSE list_position(s.question_pages, p.page_index) END::BIGINT AS page_pos, p.page_index, p.q::BIGINT AS q, 'p' || p.page_index || '-q' || p.number AS id FROM parsed p JOIN latest s USING (session_id)"""),
    "export_unicode": _w(QUESTIONS, last=_export("stem", "options")),
    "export_legacy": _w(QUESTIONS, last=_export(SPLIT_STEM, SPLIT_OPTIONS)),
    "kind_counts": _w(QUESTIONS, last="SELECT kind, count(*) AS questions FROM qs GROUP BY kind"),
    "kind_lists": _w(QUESTIONS, last="SELECT question_id, kind, number FROM qs"),
    "tab_counts": _w(QUESTIONS, ITEMS, LATEST, SHEETS, answers("sheet"), last="SELECT session_id, kind AS tab, count(*) AS n FROM qs GROUP BY ALL UNION ALL SELECT session_id, 'answers', count(DISTINCT label) FROM labelled WHERE answer IS NOT NULL GROUP BY session_id"),
    "session_merged": """
WITH parts AS (SELECT session_id, saved_at, answer_page, CASE WHEN second(saved_at) % 2 = 0 THEN source_name END AS source_name, CASE WHEN second(saved_at) % 2 = 0 THEN step END AS step FROM exam_session WHERE session_id IS NOT NULL)
SELECT session_id, max(epoch_us(saved_at)) AS saved_us, (list(answer_page ORDER BY saved_at DESC, source_name DESC NULLS LAST) FILTER (answer_page IS NOT NULL))[1] AS answer_page,
  (list(source_name ORDER BY saved_at DESC, source_name DESC) FILTER (source_name IS NOT NULL))[1] AS source_name, (list(step ORDER BY saved_at DESC, source_name DESC NULLS LAST) FILTER (step IS NOT NULL))[1] AS step FROM parts GROUP BY session_id""",
    "session_resolve": "SELECT s AS session_id, s NOT IN (SELECT session_id FROM exam_session WHERE session_id IS NOT NULL) AS is_new FROM (SELECT DISTINCT unnest([session_id, session_id || '-new']) AS s FROM positioned_item WHERE session_id IS NOT NULL)",
    "session_initial": "SELECT s AS session_id, '' AS source_name, 'pdf' AS source_kind, NULL::INTEGER AS answer_page, false AS has_no_answer_sheet, 1 AS step, 1700000000000000 AS created_us, 0 AS pages, 0 AS answers FROM (SELECT DISTINCT unnest([session_id, session_id || '-new']) AS s FROM positioned_item WHERE session_id IS NOT NULL) WHERE s NOT IN (SELECT session_id FROM exam_session WHERE session_id IS NOT NULL)",
    "session_back": _w(LATEST, last="SELECT session_id, 3 AS step, answer_page, 0 AS answers FROM latest"),
    "session_step": _w(LATEST, last="SELECT session_id, CASE WHEN step < 4 THEN step + 1 ELSE 4 END AS step FROM latest"),
    "session_stale": """
WITH saves AS (SELECT session_id, to_json({'questionPages': question_pages, 'answerPage': answer_page, 'hasNoAnswerSheet': has_no_answer_sheet})::VARCHAR AS c, saved_at FROM exam_session WHERE session_id IS NOT NULL),
listed AS (SELECT session_id, list(c ORDER BY saved_at DESC, c DESC) AS l FROM saves GROUP BY 1)
SELECT session_id, coalesce(l[1] <> l[2], true) AS stale FROM listed""",
    "session_latest": _w(LATEST, last="SELECT session_id, source_name, step, answer_page, epoch_us(saved_at) AS saved_us FROM latest"),
    "session_keep_one": "SELECT session_id, epoch_us(saved_at) AS saved_us, step FROM exam_session WHERE session_id = 's00000001'",
    "selection_key": _w(LATEST, last="SELECT session_id, to_json({'questionPages': question_pages, 'answerPage': answer_page, 'hasNoAnswerSheet': has_no_answer_sheet})::VARCHAR AS selection_key FROM latest"),
    "resume_pages": _w(ITEMS, STATS, LATEST, last="""
SELECT session_id, unnest(question_pages) AS page_index FROM latest
UNION ALL SELECT session_id, page_index FROM stats WHERE markers >= 4 AND ratio < 0.2 AND session_id IN (SELECT session_id FROM latest WHERE coalesce(len(question_pages), 0) = 0)"""),
    "resume_answer": _w(ITEMS, STATS, LATEST, last="""
SELECT s.session_id, CASE WHEN coalesce(s.has_no_answer_sheet, false) THEN NULL ELSE coalesce(s.answer_page, a.page_index) END AS answer_page
FROM latest s LEFT JOIN (SELECT session_id, page_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ratio DESC, page_index) AS r FROM stats WHERE ints >= 40 AND ratio >= 0.15) WHERE r = 1) a ON a.session_id = s.session_id"""),
    "range_toggle": _w(LATEST, last="""
SELECT session_id, array_to_string(list_sort(CASE WHEN list_contains(question_pages, 4) THEN list_filter(question_pages, lambda p: p NOT BETWEEN 1 AND 4) ELSE list_distinct(list_concat(question_pages, [1, 2, 3, 4])) END), ',') AS pages
FROM latest WHERE question_pages IS NOT NULL"""),
    "apply_edits": _w(QUESTIONS, last="""
SELECT question_id, stem || CASE WHEN kind = 'figure' THEN ' *' ELSE '' END AS stem, array_to_string(CASE WHEN kind = 'figure' THEN list_reverse(options) ELSE options END, '|') AS options,
  CASE WHEN kind = 'figure' THEN 'special' ELSE kind END AS kind, CASE WHEN kind <> 'figure' THEN correct_answer WHEN page_index % 2 = 0 THEN NULL WHEN page_index % 3 = 0 THEN 1 ELSE correct_answer END AS correct_answer,
  edited OR kind = 'figure' AS edited FROM qs"""),
    "set_answers": _w(QUESTIONS, last="SELECT question_id, CASE number WHEN 3 THEN 1 WHEN 5 THEN NULL WHEN 8 THEN 6 ELSE correct_answer END AS correct_answer, edited OR coalesce(number IN (3, 5, 8), false) AS edited FROM qs"),
    "set_answers_key": _w(QUESTIONS, ITEMS, LATEST, SHEETS, answers("sheet"), KEY, "hit AS (SELECT DISTINCT session_id, number FROM qs WHERE number IN (3, 5, 8))", last="""
SELECT session_id, label, answer FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.session_id = k.session_id AND h.number = k.label)
UNION ALL SELECT session_id, number::BIGINT, (number - 2)::BIGINT FROM hit WHERE number <> 5"""),
    "debounced_keystrokes": """
WITH strokes AS (SELECT user_id, epoch_us(ts) + d AS us, event_id * 4 + n AS stroke FROM events, (VALUES (0, 0), (1, 300000), (2, 700000), (3, 1500000)) AS k(n, d))
SELECT user_id, us AS burst_end, stroke AS value FROM (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, stroke) - us AS pause FROM strokes) WHERE pause IS NULL OR pause >= 400000""",
    "debounced_writes": "SELECT user_id, epoch_us(ts) AS burst_end, value FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS pause FROM events) WHERE pause IS NULL OR pause >= 86400000000",
    "url_audit": _w(HOSTS, last="SELECT host, count(*) AS n, CASE WHEN host IN ('cdn.jsdelivr.net', 'unpkg.com', 'cdnjs.cloudflare.com', 'esm.sh', 'fonts.googleapis.com', 'fonts.gstatic.com', 'raw.githubusercontent.com') THEN 'asset' ELSE 'unknown' END AS reason FROM hosts WHERE host NOT IN ('classroom.net') GROUP BY host"),
    "affine_regions": _w(IMAGES, last="""
SELECT region_id, k, round(bx, 6) AS x, round("by", 6) AS y, round(bw, 6) AS w, round(bh, 6) AS h FROM (
  SELECT region_id, 0 AS k, x + least(w, 0) AS bx, y + least(h, 0) AS "by", abs(w) AS bw, abs(h) AS bh FROM imgs WHERE w IS NOT NULL
  UNION ALL SELECT region_id, 1, x - greatest(h, 0), y + least(w, 0), abs(h), abs(w) FROM imgs WHERE w IS NOT NULL
  UNION ALL SELECT region_id, 2, x, y, 1, 1 FROM imgs WHERE w IS NOT NULL
  UNION ALL SELECT region_id, 3, least(w, 0), least(h, 0), abs(w), abs(h) FROM imgs WHERE w IS NOT NULL)"""),
    "screen_boxes": _w(RAW, last="SELECT rq_id, x * 1.4 - 6 AS \"left\", (842.0 - y - 9) * 1.4 - 6 AS top, w * 1.4 + 12 AS width, (h + 9) * 1.4 + 6 + 2 AS height FROM raws"),
    "failed_pages": _w(LATEST, last="SELECT session_id, array_to_string(list_transform(ocr_failed_pages, lambda p: (p + 1)::VARCHAR), ', ') AS label FROM latest WHERE len(ocr_failed_pages) > 0"),
}
