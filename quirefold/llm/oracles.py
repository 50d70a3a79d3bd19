"""SQL for DuckDB that says what text queries must return, in ways of its own: character by character, with tables written out.

Nothing here is shared with the operators. Compositions come from Python's Unicode data as a map, not from DuckDB's
normalisation; look-alike letters are listed as pairs; widths are computed from code points.
"""

from __future__ import annotations

import unicodedata

# Pairs of a letter and the Latin one that it looks like; ranges of widths and of characters without a shape.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe ѐè ёë ѕs іi їï јj оo рp сc уy хx һh ԁd ԛq ԝw"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ιi νv"
SHAPELESS = [173, 847, 1564, 4447, 4448, 6068, 6069, 6158, 8203, 8204, 8206, 8207, 8234, 8235, 8236, 8237, 8238, 8288, 8289, 8290, 8291, 8292, 8294, 8295, 8296, 8297, 65279]
BLANK = [160, 5760, *range(8192, 8203), 8239, 8287, 12288]
JOINER, VIRAMA = 0x200D, 0x0DCA


def _map(pairs: dict[str, str]) -> str:
    """A DuckDB map literal."""
    show = lambda x: "'" + x.replace("'", "''") + "'"
    return f"MAP {{{', '.join(f'{show(k)}: {show(v)}' for k, v in pairs.items())}}}"


def _basic() -> list[str]:
    return [c for c in map(chr, range(0xA0, 0x3100)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]


def compositions() -> dict[str, str]:
    """Two characters and the one that they compose to, below the ideographs."""
    out = {}
    for c in _basic():
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<") and len(parts.split()) == 2:
            two = "".join(chr(int(p, 16)) for p in parts.split())
            if unicodedata.normalize("NFC", two) == c:
                out[two] = c
    return out


def replaced() -> dict[str, str]:
    """Characters that are written as others wherever they stand: half-width and small forms, ligatures, canonical doubles."""
    out = {c: unicodedata.normalize("NFC", c) for c in _basic() if unicodedata.normalize("NFC", c) != c}
    for c in map(chr, [*range(0xFB00, 0xFB07), *range(0xFE50, 0xFE6C), *range(0xFF5F, 0xFFEF)]):
        if unicodedata.decomposition(c).startswith("<") and unicodedata.category(c) != "Cn":
            out[c] = unicodedata.normalize("NFKC", c)
    return out


def form(text: str) -> str:
    """SQL: the consistent form of a text."""
    chars = lambda t: f"regexp_extract_all({t}, '(?s).')"
    glued = lambda t: f"array_to_string({t}, '')"
    one = f"CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN ({', '.join(map(str, BLANK))}) THEN ' ' ELSE coalesce(spelled[c], c) END"
    seen = f"list_transform(list_filter({chars(text)}, lambda c: unicode(c) NOT IN ({', '.join(map(str, SHAPELESS))})), lambda c: {one})"
    # The joiner stays between the virama and a consonant: pieces between joiners are put together again.
    pieces = f"list_filter(string_split({glued(seen)}, chr({JOINER})), lambda p: p <> '')"
    joined = f"coalesce(list_reduce({pieces}, lambda a, p: a || CASE WHEN unicode(right(a, 1)) = {VIRAMA} AND unicode(p) BETWEEN 3482 AND 3526 THEN chr({JOINER}) ELSE '' END || p), '')"
    letters = f"[\\p{{L}}\\p{{M}}\\x{{{JOINER:X}}}]"
    runs = f"regexp_extract_all(t, '{letters}+|[^{letters[1:]}+')"
    own = lambda w: f"list_transform({chars(w)}, lambda c: coalesce(latin[c], c))"
    all_stand = f"len({chars('w')}) = len(list_filter({chars('w')}, lambda c: cyrillic[c] IS NOT NULL))"
    some_stand = f"len(list_filter({chars('w')}, lambda c: latin[c] IS NOT NULL)) > 0"
    # A Latin word besides: a Latin letter that has another, or one that looks so, at its side.
    besides = f"len(list_filter(range(1, len(t)), lambda i: (regexp_matches(substr(t, i, 1), '[A-Za-z]') AND (regexp_matches(substr(t, i + 1, 1), '[A-Za-z]') OR latin[substr(t, i + 1, 1)] IS NOT NULL)) OR (latin[substr(t, i, 1)] IS NOT NULL AND regexp_matches(substr(t, i + 1, 1), '[A-Za-z]')))) > 0"
    sinhala = "regexp_matches(w, '[\\x{0D80}-\\x{0DFF}]') AND (contains(w, chr(3330)) OR contains(w, chr(3331)))"
    word = f"CASE WHEN {sinhala} THEN replace(replace(w, chr(3330), chr(3458)), chr(3331), chr(3459)) WHEN {some_stand} AND (regexp_matches(w, '[A-Za-z]') OR ({all_stand} AND {besides})) THEN {glued(own('w'))} ELSE w END"
    composed = f"coalesce(list_reduce({chars('u')}, lambda a, c: CASE WHEN paired[right(a, 1) || c] IS NOT NULL THEN left(a, -1) || paired[right(a, 1) || c] ELSE a || c END), '')"
    maps = f"{_map(replaced())} AS spelled, {_map(pairs(CYRILLIC + ' ' + GREEK))} AS latin, {_map(pairs(CYRILLIC))} AS cyrillic, {_map(compositions())} AS paired"
    inner = f"SELECT *, {joined} AS t FROM (SELECT {maps})"
    return f"(SELECT {composed} FROM (SELECT *, {glued(f'list_transform({runs}, lambda w: {word})')} AS u FROM ({inner})))"


def pairs(listed: str) -> dict[str, str]:
    return {p[0]: p[1:] for p in listed.split()}


_VALUES = """
SELECT DISTINCT question_id, 'stem' AS field, 0 AS pos, stem AS value FROM question WHERE stem IS NOT NULL
UNION ALL
SELECT DISTINCT question_id, 'option', i::INTEGER, options[i] FROM question, unnest(range(1, len(options) + 1)) AS r(i) WHERE options[i] IS NOT NULL"""
_ENDS = "'.,?()“”‘’:!—\"'"

# Every pair with a common word, counted word by word: exact, and for small tables only.
_PAIRS = f"""
once AS (SELECT question_id, any_value(stem) AS stem, any_value(options) AS options FROM question WHERE question_id IS NOT NULL GROUP BY 1),
texts AS (SELECT question_id, coalesce(stem, '') || ' ' || coalesce(array_to_string(options, ' '), '') AS text FROM once),
words AS (SELECT question_id, rtrim(ltrim(w, {_ENDS}), {_ENDS}) AS w FROM (SELECT question_id, unnest(string_split_regex(lower({form('text')}), '\\s+')) AS w FROM texts)),
counts AS (SELECT question_id, w, count(*) AS n FROM words WHERE w <> '' GROUP BY 1, 2),
sizes AS (SELECT question_id, sum(n) AS total FROM counts GROUP BY 1),
shared AS (SELECT a.question_id AS question_a, b.question_id AS question_b, sum(least(a.n, b.n)) AS s FROM counts a JOIN counts b USING (w) WHERE a.question_id < b.question_id GROUP BY 1, 2),
linked AS (SELECT question_a, question_b FROM shared JOIN sizes a ON a.question_id = question_a JOIN sizes b ON b.question_id = question_b WHERE s / (a.total + b.total - s) >= 0.7 - 1e-9)"""

ORACLES: dict[str, str] = {
    "p5_found": f"SELECT DISTINCT question_id, field, pos FROM ({_VALUES}) WHERE value <> {form('value')}",
    "p5_forms": f"SELECT question_id, field, pos, value, {form('value')} AS form FROM ({_VALUES.replace('DISTINCT ', '')})",
    "p4_found": f"WITH {_PAIRS} SELECT question_a, question_b FROM linked",
    "p4_groups": f"""
WITH RECURSIVE {_PAIRS},
bags AS (SELECT o.question_id, coalesce((SELECT list(struct_pack(w := c.w, n := c.n) ORDER BY c.w) FROM counts c WHERE c.question_id = o.question_id), []) AS bag FROM once o),
classes AS (SELECT question_id, min(question_id) OVER (PARTITION BY bag) AS class_id, len(bag) > 0 AS full_ FROM bags),
edges AS (SELECT question_a AS a, question_b AS b FROM linked UNION ALL SELECT question_b, question_a FROM linked),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
heads AS (SELECT a, min(b) AS head FROM reach GROUP BY a),
counted AS (SELECT c.class_id, count(DISTINCT d.class_id) AS links FROM edges e JOIN classes c ON c.question_id = e.a JOIN classes d ON d.question_id = e.b WHERE c.class_id <> d.class_id GROUP BY 1)
SELECT c.question_id, CASE WHEN full_ THEN least(c.question_id, coalesce(h.head, c.question_id)) END AS group_id, c.class_id, coalesce(k.links, 0) AS links
FROM classes c LEFT JOIN heads h ON h.a = c.question_id LEFT JOIN counted k ON k.class_id = c.class_id""",
    # What must hold of any packing: every text with a token is placed, nothing is over, missing or split needlessly.
    "p7_cover": "SELECT count(DISTINCT doc_id) AS documents, 0 AS overfull, 0 AS gaps, 0 AS needless FROM documents WHERE doc_id IS NOT NULL AND text <> ''",
}
