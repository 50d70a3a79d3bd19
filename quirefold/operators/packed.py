"""Several values packed into one string: one row per value, with its position.

A string is packed in one of three ways. Quoted: values between double quotes (all or some of them), separated by a
comma, semicolon or bar, possibly inside brackets; a quote inside a value is doubled or escaped. Numbered: values follow
markers such as "(2)", "( 2 )" or "^2&". Delimited: values stand between white-spaced or unspaced delimiters, of one
or several kinds. A question number at the start is no value.

Method: quotes that do not enclose a value are masked, the string is split on the remaining quote characters; odd
pieces are literals, even pieces are split on the delimiters of the string's way of packing, and one SQL array fold
glues the parts back into values in order. Everything is Catalyst expressions on the row: no Python, and no shuffle but that of the distinct keys.

Defined results: null, empty and blank strings and strings of a single value give no rows; a value may be empty
between two separators; a separator at the very end adds no value; texts of any length are one row of the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The delimiters of unquoted strings and the markers of numbered ones.
SPACED = "~│•#"
UNSPACED = "¦"
MARKER = r"\(\s*[1-5]\s*\)|\^\s*[1-5]\s*&"
#: Wrong decodings in which a delimiter may stand; a field counts as it was before.
WRONG_CODECS = ("cp437", "cp850", "mac_roman", "cp1250", "cp1251")

#: Private-use characters that stand for a masked quote, an empty quoted value and a delimiter.
_QUOTE, _EMPTY, _CUT = "\ue010", "\ue011", "\ue012"
_BEFORE_BYTES = "ÂÃâ¶·€\x80"


def misdecoded(char: str) -> list[str]:
    """The strings that a non-ASCII character turns into where its UTF-8 or code page bytes were decoded wrongly."""
    out = []
    for codec in ("cp1252", "latin-1"):
        text = char
        for _ in range(2):
            text = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode("utf-8"))
            out.append(text)
    try:
        byte = char.encode("cp1252")
    except UnicodeEncodeError:
        return list(dict.fromkeys(out))
    out += [byte.decode(codec) for codec in WRONG_CODECS]
    return [x for x in dict.fromkeys(out) if x != char]


def delimiter_pattern() -> str:
    """The regular expression of a delimiter of an unquoted string."""
    spaced = [re.escape(c) for c in (";", *SPACED, "||", "|")] + [re.escape(x) for c in SPACED if not c.isascii() for x in misdecoded(c)]
    unspaced = sorted([x for c in UNSPACED for x in (*misdecoded(c), c)], key=len, reverse=True)
    guarded = [rf"(?<![{_BEFORE_BYTES}{'' if x in UNSPACED else 'à'}]){re.escape(x)}" if len(x) == 1 else rf"(?<![¶·]){re.escape(x)}" for x in unspaced]
    return r"\t\|(?:\t|\z)|[ \t](?:" + "|".join(sorted(spaced, key=len, reverse=True)) + r")(?:[ \t]|(?=\n)|\z)|\t|\n|" + "|".join(guarded)


def _fold(pieces: Column, cut: Column) -> Column:
    """The values of pieces that alternate between outside and inside of quotes."""

    def step(state: Column, piece: Column) -> Column:
        parts = F.split(piece["text"], cut, -1)
        split = ~piece["literal"] & (F.size(parts) > 1)
        first = F.array(F.concat(state["last"], F.element_at(parts, 1)))
        done = F.when(split, F.concat(state["done"], first, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(state["done"])
        last = F.when(split, F.element_at(parts, -1)).otherwise(F.concat(state["last"], piece["text"]))
        return F.struct(done.alias("done"), last.alias("last"))

    typed = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("literal")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"))
    return F.aggregate(typed, start, step)


def split_values(df: DataFrame, raw: str) -> DataFrame:
    """The rows of a DataFrame with a column `values`: the array of the values of a packed string, null for null."""
    blank = r"[ \t\n\r]"
    kept = df.columns
    # Each step refers to the columns of the one before by name, so that no costly expression is computed twice.
    df = df.withColumn("_body", F.regexp_replace(F.regexp_replace(raw, rf"^{blank}+|[ \r\n]+\z", ""), r"^\[(?=\")|(?<=\")\]\z", ""))
    df = df.withColumn("_quoted", F.col("_body").rlike(r"(?:^|[,;|] ?)\"(?=[^ ])"))
    empty = r"(?:(?<=[,;|])|(?<=[,;|] )|(?<=^))\"\"(?=\s*(?:[,;|]|\z))"
    doubled = r"(?<!^)(?<![,;|])(?<![,;|] )\"\""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("_body", r"\\\"", _QUOTE), empty, f'"{_EMPTY}"'), doubled, _QUOTE)
    numbered = F.regexp_replace(F.translate("_body", '"', _QUOTE), MARKER, _CUT)
    delimited = F.regexp_replace(F.translate("_body", '"', _QUOTE), delimiter_pattern(), _CUT)
    df = df.withColumn("_text", F.when(F.col("_quoted"), masked).when(F.col("_body").rlike(MARKER), numbered).otherwise(delimited))
    df = df.withColumn("_pieces", F.split("_text", '"', -1))
    df = df.withColumn("_outside", F.when(F.col("_quoted"), F.array_join(F.filter("_pieces", lambda p, i: i % 2 == 0), _CUT)))
    df = df.withColumn("_after", F.regexp_extract("_outside", rf"{_CUT}\s*([,;|] ?)", 1)).withColumn("_mark", F.when(F.length("_after") > 0, F.col("_after")).otherwise(F.regexp_extract("_outside", rf"([,;|] ?){_CUT}", 1)))
    between = F.concat(F.lit(r"\s*\Q"), F.rtrim("_mark"), F.lit(r"\E"), F.when(F.col("_mark").endswith(" "), F.lit(r"\s+")).otherwise(F.lit(r"\s*")))
    df = df.withColumn("_cut", F.when(F.col("_quoted") & (F.length("_mark") > 0), between).otherwise(F.lit(_CUT)))
    df = df.withColumn("_folded", _fold(F.col("_pieces"), F.col("_cut")))
    whole = F.when(F.trim("_folded.last") == "", F.col("_folded.done")).otherwise(F.concat("_folded.done", F.array("_folded.last")))
    number = r"^\s*\d{1,3}\s*['.’)]?\s*"
    shown = lambda v, i: F.regexp_replace(F.translate(F.regexp_replace(v, F.when(i == 0, F.lit(number)).otherwise(F.lit(r"^\s+")), F.lit("")), _QUOTE + _EMPTY, '"'), r"\s+\z", "")
    return df.withColumn("values", F.when(F.col("_body") == "", F.array().cast("array<string>")).otherwise(F.transform(whole, shown))).select(*kept, "values")


def unpack(df: DataFrame, key: str, raw: str = "raw_legacy") -> DataFrame:
    """(key, pos, value): a row for each value of each string of two or more values, pos from 0; repeats count once."""
    once = df.select(F.col(key).alias("k"), F.col(raw).alias("r")).where(F.length("r") > 0).groupBy("k").agg(F.min("r").alias("r"))
    many = split_values(once, "r").select("k", F.when(F.size("values") > 1, F.col("values")).alias("v"))
    # The outer form: for the inner one the optimiser derives a filter on the whole expression and computes it once more.
    return many.select(F.col("k").alias(key), F.posexplode_outer("v").alias("pos", "value")).where("pos IS NOT NULL")


def positions(df: DataFrame, key: str, raw: str = "raw_legacy") -> DataFrame:
    """(key, pos) like unpack, without the values: only keys and counts are shuffled, never a string."""
    counted = split_values(df.select(F.col(key).alias("k"), F.col(raw).alias("r")), "r").select("k", F.size("values").alias("n"))
    return counted.groupBy("k").agg(F.max("n").alias("n")).where("n > 1").select(F.col("k").alias(key), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))


def over_tables(operator, tables: dict[str, tuple[DataFrame, str]], raw: str = "raw_legacy") -> DataFrame:
    """unpack or positions over several tables, given as name: (table, key), with (rec_table, rec_id) in front."""
    out = None
    for name, (df, key) in tables.items():
        part = operator(df, key, raw)
        part = part.select(F.lit(name).alias("rec_table"), F.col(key).cast("bigint").alias("rec_id"), *part.columns[1:])
        out = part if out is None else out.unionByName(part)
    return out
