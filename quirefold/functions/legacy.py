"""Legacy (FM font) text to Sinhala: longest-match tokens, vowel reordering and pair replacement, as Catalyst expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token table of the FM fonts; U+E000 marks a sign that later joins its vowel.
TOKENS = {
    "b": "\u0d89", "w": "\u0d85", "wd": "\u0d86", "we": "\u0d87", "wE": "\u0d88", "t": "\u0d91", "ft": "\u0d93", "T": "\u0d94", "T!": "\u0d96",
    "W": "\u0d8b", "´": "\u0d95", "B": "\u0d8a", "l": "\u0d9a", ".": "\u0d9c", "p": "\u0da0", "c": "\u0da2", "g": "\u0da7", "v": "\u0da9", "K": "\u0dab",
    ";": "\u0dad", ":": "\u0dae", "o": "\u0daf", "±": "\u0daf", "O": "\u0db0", "k": "\u0db1", "|": "\u0db3", "m": "\u0db4", "n": "\u0db6", "N": "\u0db7",
    "u": "\u0db8", "U": "\u0db9", "ò": "\u0db9", "h": "\u0dba", "r": "\u0dbb", ",": "\u0dbd", "j": "\u0dc0", "Y": "\u0dc1", "I": "\u0dc2", "i": "\u0dc3",
    "y": "\u0dc4", "<": "\u0dc5", "G": "\u0da8", "P": "\u0da2", "x": "\u0d82", "d": "\u0dcf", "e": "\u0dd0", "E": "\u0dd1", "s": "\u0dd2", "S": "\u0dd3",
    "=": "\u0dd4", "q": "\u0dd4", "Q": "\u0dd6", "+": "\u0dd6", "D": "\u0dd8", "!": "\u0ddf", "f": "\u0dd9", "ff": "\u0ddb", "a": "\u0dca",
    "A": "\u0dca", "%": "\u0dca\u200d\u0dbb", "H": "\u0dca\u200d\u0dba", "¾": "\u0dbb\u0dca", "á": "\u0da7\u0dd2", "ä": "\u0da9\u0dd2",
    "Ü": "\u0da7\u0dca", "Ó": "\u0dae\u0dd3", "È": "\u0daf\u0dd2", "§": "\u0daf\u0dd3", "ê": "\u0db0\u0dd2", "ë": "\u0db0\u0dd3", "÷": "\u0db3\u0dd4",
    "î": "\u0db6\u0dd3", "ñ": "\u0db8\u0dd2", "ï": "\u0db8\u0dca", "Ñ": "\u0da0\u0dd2", "Ô": "\u0da2\u0dd3", "ß": "\u0dbb\u0dd2", "Í": "\u0dbb\u0dd3",
    "re": "\u0dbb\u0dd4", "¨": "\u0dbd\u0dd4", "ú": "\u0dc0\u0dd2", "ù": "\u0dc0\u0dd3", "õ": "\u0dc0\u0dca", "¿": "\u0dc5\u0dd4",
    "ø": "\u0daf\u0dca\u200d\u0dbb", "É": "\u0dad\u0dca", "ÿ": "\u0daf\u0dd4", "ó": "\u0db8\u0dd3", "ì": "\u0db6\u0dd2", "í": "\u0db6\u0dca",
    "C": "\u0d9a\u0dca", "/": "\u0dbb\u0dd0", "¥": "\u0daf\u0dd6", "M": "\u0db5", "L": "\u0d9b", "Ë": "\u0d9a\u0dca\u0dc2", "Ê": "\u0da2\u0dca",
    "à": "\u0da7\u0dd3", "¢": "\u0db3\u0dd2", "þ": "\u0da1\u0dca", ">": "\u0d9d", "J": "\u0db1\u0dca", "Æ": "!", "æ": "!", "`o": "\u0db3",
    "`.": "\u0d9f", "`§": "\u0db3\u0dd3", "`ÿ": "\u0db3\u0dd4", "da": "\ue000", "^": "(", "&": ")", "'": ".", "\"": ",", "(": ":", "$": "/", "@": "?",
    "²": "\u2022", "z": "\u2018", "Z": "\u2019", "{": "\u0da5", "_": "\u0dd3",
}
#: The fonts that use the table.
FONTS = ("FMAbhayax", "FMAbabldBold", "FMSamanthax", "FMDeranax", "FMGanganeex", "FMEmaneex")
UNMAPPED = "\u27e8?\u27e9"

# Classes of signs, and pairs of signs that make one, in the order in which they are replaced.
_PREFIX = "ෙේෛ"
_CONSONANT = "ක-ෆ"
PAIRS = (
    ("ේ", "ේ"), ("ො", "ො"), ("ෞ", "ෞ"), ("ේා", "ෝ"),
    ("ෙ\ue000", "ෝ"), ("ෙෙ", "ෛ"), ("\ue000", "ා"),
)
_PASSED = r"[0-9\-\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: A prefix vowel run with the consonant cluster that it stands before, or a stretch without prefix vowels.
_CLUSTER = f"(?s)[{_PREFIX}][^{_CONSONANT}]*(?:[{_CONSONANT}](?:්\u200d[{_CONSONANT}])*|\\z)|[^{_PREFIX}]+"


def token_pattern() -> str:
    """The regular expression of one token: the two-character ones first, then any character."""
    return "(?s)" + "|".join(re.escape(t) for t in TOKENS if len(t) == 2) + "|."


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(token_pattern()), 0)


def _table() -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(TOKENS.items())))


def convert(text: Column) -> Column:
    """Legacy text as Unicode: map the tokens, move prefix vowels behind their cluster, join pairs of signs."""
    table = _table()
    mapped = F.transform(_tokens(text), lambda t: F.coalesce(F.try_element_at(table, t), F.when(t.rlike(f"^{_PASSED}\\z"), t).otherwise(F.lit(UNMAPPED))))
    clusters = F.regexp_extract_all(F.array_join(mapped, ""), F.lit(_CLUSTER), 0)
    moved = F.transform(clusters, lambda s: F.concat(F.regexp_replace(s, f"[{_PREFIX}]", ""), F.regexp_replace(s, f"[^{_PREFIX}]", "")))
    out = F.array_join(moved, "")
    for pair, sign in PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(sign))
    return F.regexp_replace(out, f"([ා-ෟ])(්\u200d[{_CONSONANT}])", "$2$1")


def unmapped(text: Column) -> Column:
    """How many characters of a legacy text have no token."""
    table = _table()
    return F.size(F.filter(_tokens(text), lambda t: F.try_element_at(table, t).isNull() & ~t.rlike(f"^{_PASSED}\\z"))).cast("bigint")


def strip_prefix(font: Column) -> Column:
    """A font name without the subset prefix of six capitals."""
    return F.regexp_replace(font, r"^[A-Z]{6}\+", "")


def uses_table(text: Column, font: Column) -> Column:
    """Whether a fragment is legacy-encoded: a known or FM font, and no Sinhala character in the text. Null fonts are not."""
    name = strip_prefix(font)
    return F.coalesce((name.isin(*FONTS) | name.rlike("(?i)^FM")) & ~text.rlike("[\u0d80-\u0dff]"), F.lit(False))
