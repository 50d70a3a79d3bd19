"""Text helpers whose white space is that of the data model: Unicode spaces, line separators and the byte order mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space characters, for inside a character class.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACE}]"

# Fixed patterns of question text.
OPENER = rf"^{WS}*([0-9]{{1,2}})(?:{WS}*['.’]{WS}*(?=[^{SPACE}])|(?=[^{SPACE}0-9]))"
MARKER = rf"\^{WS}*[1-5]{WS}*&|\({WS}*[1-5]{WS}*\)"


def trim(text: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def squeeze(text: Column | str) -> Column:
    """The trimmed text with each run of white space as one blank."""
    return trim(F.regexp_replace(text, f"{WS}+", " "))


def is_integer(text: Column | str) -> Column:
    """Whether the trimmed text is nothing but digits."""
    return trim(text).rlike(r"^[0-9]+\z")


def is_page_number(text: Column | str) -> Column:
    """Whether the trimmed text is an integer of at most three digits."""
    return trim(text).rlike(r"^[0-9]{1,3}\z")


def is_opener(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(OPENER)


def opener_number(text: Column | str) -> Column:
    """The question number that a line opens with, null where it opens none."""
    return F.regexp_extract(text, OPENER, 1).try_cast("int")


def without_opener(text: Column | str) -> Column:
    return F.regexp_replace(text, OPENER, "")


def split_options(text: Column) -> Column:
    """The text before the first option marker, and the trimmed text after each marker."""
    return F.transform(F.split(text, MARKER, -1), lambda part, i: F.when(i == 0, part).otherwise(trim(part)))
