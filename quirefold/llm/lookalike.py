"""One consistent form for texts that look the same: widths, spaces, invisible characters, accents, look-alike letters.

DuckDB runs inside each Arrow partition and computes the form in embedded SQL (translate, regular expressions,
nfc_normalize); a batch is a table of it and nothing is read twice.

The form of a text: full-width and other compatibility forms become ordinary characters, all spaces become U+0020,
invisible characters go except the joiner inside a Sinhala conjunct (virama, joiner, consonant), the rest is composed
(NFC), and letters of another script that stand in for look-alikes are replaced inside a word. A word is mixed if it
holds a letter of its own script beside stand-ins, so that Greek, Cyrillic and other foreign words stay as they are; a
word all of whose letters are stand-ins for Latin ones is also taken for Latin if the text holds a Latin word besides.

Defined results: null gives null, an empty text stays empty, line breaks and tabs stay, text of any length is one value.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import decomposition, normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import codepoints

# Characters and the ordinary ones that look like them.
SPACES = "\u00a0\u1680" + codepoints(0x2000, 0x200A) + "\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХаеѐёѕіїјорсухһԁԛԝ", "ABESIJKMHOPCTYXaeèësiïjopcyxhdqw"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv"
MALAYALAM, MALAYALAM_AS = "\u0d02\u0d03", "\u0d82\u0d83"
JOINER, KEPT = "\u200d", "\ue001"

#: Full-width, half-width and small forms, by Unicode's own data; each becomes one or two ordinary characters.
_WIDTHS = {c: normalize("NFKC", c) for c in codepoints(0xFE50, 0xFE6B) + codepoints(0xFF01, 0xFFEE) if decomposition(c).startswith(("<wide>", "<narrow>", "<small>"))}
WIDE = "".join(c for c, x in _WIDTHS.items() if len(x) == 1)
WIDE_AS = "".join(_WIDTHS[c] for c in WIDE)
STANDINS, STANDINS_AS = CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """SQL of the consistent form of a column; regular expressions are RE2."""
    sql = f"translate({column}, {quoted(WIDE + SPACES)}, {quoted(WIDE_AS + ' ' * len(SPACES))})"
    for ligature, letters in LIGATURES.items():
        sql = f"replace({sql}, {quoted(ligature)}, {quoted(letters)})"
    sql = f"translate({sql}, {quoted(INVISIBLE)}, '')"
    sql = f"regexp_replace({sql}, '(\\x{{0DCA}})\\x{{200D}}+([\\x{{0D9A}}-\\x{{0DC6}}])', '\\1{KEPT}\\2', 'g')"
    sql = f"translate({sql}, {quoted(KEPT + JOINER)}, {quoted(JOINER)})"
    sinhala = f"CASE WHEN regexp_matches(w, '[{MALAYALAM}]') AND regexp_matches(w, '[\\x{{0D80}}-\\x{{0DFF}}]') THEN translate(w, {quoted(MALAYALAM)}, {quoted(MALAYALAM_AS)})"
    latin = f"WHEN regexp_matches(w, '[{STANDINS}]') AND (regexp_matches(w, '[A-Za-z]') OR (regexp_full_match(w, '[{CYRILLIC}]+') AND regexp_matches(plain_, '[A-Za-z][A-Za-z{STANDINS}]|[{STANDINS}][A-Za-z]'))) THEN translate(w, {quoted(STANDINS)}, {quoted(STANDINS_AS)}) ELSE w END"
    words = f"list_transform(regexp_extract_all(plain_, '[\\p{{L}}\\p{{M}}{JOINER}]+|[^\\p{{L}}\\p{{M}}{JOINER}]+'), lambda w: {sinhala} {latin})"
    # Composed last: an accent may stand on a stand-in.
    return f"(SELECT nfc_normalize(CASE WHEN regexp_matches(plain_, '[{MALAYALAM}{STANDINS}]') THEN array_to_string({words}, '') ELSE plain_ END) FROM (SELECT {sql} AS plain_))"


#: Characters any of which a text must hold, or a combining mark, to differ from its form. Other texts are their form.
SUSPECT = "[^\\x{0000}-\\x{007F}\\x{00A1}-\\x{00AC}\\x{00AE}-\\x{02FF}\\x{0D80}-\\x{0DFF}\\x{2010}-\\x{2027}\\x{2030}-\\x{205E}]|[\\x{0DCA}\\x{0DCF}\\x{0DDF}]"


def connection():
    """An in-memory DuckDB of one thread: parallelism is Spark's."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})


def map_sql(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run one SQL statement over the table `batch` in each Arrow batch of a DataFrame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("batch")
        con.close()

    return df.mapInArrow(run, schema)


def values_sql(key: str, stem: str = "stem", options: str = "options") -> str:
    """SQL: a row (key, pos, value) for the stem (pos 0) and each option (pos from 1); null values give no row."""
    return f"SELECT {key}, 0 AS pos, {stem} AS value FROM batch WHERE {stem} IS NOT NULL UNION ALL SELECT * FROM (SELECT {key}, unnest(range(1, len({options}) + 1)) AS pos, unnest({options}) AS value FROM batch) WHERE value IS NOT NULL"


def consistent_values(df: DataFrame, key: str = "question_id", stem: str = "stem", options: str = "options", differing_only: bool = False) -> DataFrame:
    """(key, field, pos, value, form) for each stem and option; with differing_only, those that differ from their form."""
    kind = df.schema[key].dataType.simpleString()
    shape = f"CASE WHEN regexp_matches(value, '{SUSPECT}') THEN {form_sql('value')} ELSE value END"
    kept = "WHERE value <> form" if differing_only else ""
    sql = f"SELECT key, CASE pos WHEN 0 THEN 'stem' ELSE 'option' END AS field, CAST(pos AS INTEGER) AS pos, value, form FROM (SELECT *, {shape} AS form FROM ({values_sql('key', 'stem', 'options')})) {kept}"
    narrow = df.select(F.col(key).alias("key"), F.col(stem).alias("stem"), F.col(options).alias("options"))
    return map_sql(narrow, sql, f"key {kind}, field string, pos int, value string, form string").withColumnRenamed("key", key)


def found(df: DataFrame, key: str = "question_id", stem: str = "stem", options: str = "options") -> DataFrame:
    """(key, field, pos), once each, of the stems and options that differ from their consistent form."""
    return consistent_values(df, key, stem, options, differing_only=True).select(key, "field", "pos").distinct()
