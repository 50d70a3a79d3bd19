"""Text that was decoded with the wrong character encoding: finding it and giving back what stood there.

Method: characters are mapped back to the bytes they were read from, a byte-structure automaton finds the maximal spans
of well-formed multibyte sequences, and only those spans are decoded; this repeats while it finds spans, since a text
may have gone wrong several times.

The automaton cannot see text of one byte code page read as another, and two legacy characters may happen to form a
sequence. Both are judged by evidence from words: the distinct words with a non-ASCII character are counted over all
texts, each is read again in every way that its characters allow, and a join with the same table says how often the
other reading stands elsewhere. A reading counts if its word is more frequent than the word as it stands and its
characters are ones that such evidence mostly supports (`support`), or if it is very much more frequent; a word that
no reading explains follows its characters only if nearly all their occurrences are explained. A character that is merely
rare, such as one of a foreign name or a glyph without a mapping, has no such words and stays.

Font names are tried in pairs of code pages, and a reading counts only if it is the name of more fragments or of the reference.

Defined results: null and empty values and plain ASCII are no cases; a null font is no reason against a case; a value
with the replacement character is a case that cannot be restored in full; in bracketed foreign words and in Sinhala
text only sequences are judged; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import legacy
from quirefold.session import stash

#: Code pages that texts were wrongly read in, and those that font names were written in.
WRONG = ("cp437", "cp850", "mac_roman", "cp1250", "cp1251", "latin-1")
FONT_RIGHT = ("cp1252", "cp1251", "koi8_r", "cp1253", "gbk", "shift_jis")
#: A reading of a character is supported if so large a share of its occurrences is in words whose reading is more frequent.
SUPPORT = 0.5
#: For words without evidence of their own: the share, and the least number of such words.
FULL_SUPPORT, LEAST_WORDS = 0.9, 3
#: How many times as frequent a reading of unsupported characters must be.
RATIO = 24

_LEGACY = {c for t in legacy.TOKENS for c in t if not c.isascii()}
_CONTINUATION = "\u0080-¿" + "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0))
#: A lead byte with its continuation bytes, as characters.
SEQUENCE = f"[Â-ß][{_CONTINUATION}]|[à-ï][{_CONTINUATION}]{{2}}|[ð-ô][{_CONTINUATION}]{{3}}"
_TO_BYTE = {chr(b): b for b in range(128, 256)} | {bytes([b]).decode("cp1252"): b for b in range(128, 256) if bytes([b]).decode("cp1252", "ignore")}
_NAME = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Sinhala}\p{Han}\p{Hiragana}\p{Katakana}0-9\-_. \u200d]+")
#: A foreign word in brackets; a list of quoted values is none.
BRACKETED = r"\[[^\[\]\"]*\]"
#: What stands between words, all of it ASCII: full stops, commas and semicolons, which are letters in legacy text, only at their ends.
_BETWEEN = r" \t\n\r\f\x0b\"'|#~@^&()\[\]{}?!:*+/\\_-"
BETWEEN = rf"(?:[{_BETWEEN}]|[.,;]+(?![^{_BETWEEN}]))+"
_BRACKETED = re.compile(f"({BRACKETED})")
_SPLIT = re.compile(f"({BETWEEN})")


def spans(text: str, to_byte: dict[str, int] = _TO_BYTE) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded) of the maximal spans of well-formed UTF-8 multibyte sequences among the text's bytes."""
    start, decoded, at = -1, [], 0
    while at < len(text):
        lead = to_byte.get(text[at], 0)
        more = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
        sequence = bytes([lead, *(to_byte.get(c, 0) for c in text[at + 1 : at + 1 + more])])
        char = ""
        if more and len(sequence) == more + 1:
            try:
                char = sequence.decode("utf-8")
            except UnicodeDecodeError:
                pass
        if char:
            start = at if start < 0 else start
            decoded.append(char)
            at += more + 1
        else:
            if start >= 0:
                yield start, at, "".join(decoded)
                start, decoded = -1, []
            at += 1
    if start >= 0:
        yield start, len(text), "".join(decoded)


def _script(char: str) -> str:
    """A coarse script: the block of 128 characters, wider for ideographs, kana and what has four bytes."""
    return "east" if "⺀" <= char <= "\ud7ff" else "far" if char > "\uffff" else str(ord(char) >> 7)


def plausible(decoded: str) -> bool:
    """Whether a decoded span can be right by itself: Latin, legacy, Greek, Cyrillic or Sinhala letters, punctuation,
    boxes, what has four bytes, or at least two characters in a row of another script."""
    for i, c in enumerate(decoded):
        kind = category(c)
        common = c in _LEGACY or "\u00a0" <= c <= "ſ" or "Ά" <= c <= "ώ" or "Ѐ" <= c <= "џ" or "\u0d80" <= c <= "\u0dff" or "\u2000" <= c <= "➿" or c == "\ufeff"
        beside = any(_script(n) == _script(c) for n in decoded[max(0, i - 1) : i] + decoded[i + 1 : i + 2])
        if kind in ("Cn", "Co", "Cs") or (kind == "Cc" and not "\x80" <= c <= "\x9f") or not (common or beside or c > "\uffff" or "\x80" <= c <= "\x9f" or _script(c) == "east"):
            return False
    return True


def decoded_again(text: str, to_byte: dict[str, int] = _TO_BYTE) -> Iterator[str]:
    """The text after each round of decoding all spans, while there are any; each round shortens it."""
    while found := list(spans(text, to_byte)):
        out, at = [], 0
        for start, end, decoded in found:
            out += [text[at:start], decoded]
            at = end
        text, to_byte = "".join(out) + text[at:], _TO_BYTE
        yield text


def repair_sequences(text: str) -> str:
    """The text with its plausible multibyte spans decoded, span by span, again while spans are found.

    A span of nothing but legacy characters may be legacy text: it is left, and needs evidence from words.
    """
    while True:
        out, at = [], 0
        for start, end, decoded in spans(text):
            own = all(c in _LEGACY for c in text[start:end])
            if any(True for _ in spans(decoded)) or (plausible(decoded) and not own):
                out += [text[at:start], decoded]
                at = end
        if not out:
            return text
        text = "".join(out) + text[at:]


def reading(wrong: str, right: str = "cp1252") -> dict[str, str]:
    """What each non-ASCII character of one code page is in another, by its byte; bytes that the other leaves open are left out."""
    out = {}
    for b in range(128, 256):
        was, now = bytes([b]).decode(wrong, "ignore"), bytes([b]).decode(right, "ignore")
        if was and now:
            out[was] = now
    return out


#: For each code page: what its characters are in the right one. All of them together are fewer than 700 characters.
_READINGS = {w: reading(w) for w in WRONG}
_BYTES = {w: {c: b for b in range(128, 256) if (c := bytes([b]).decode(w, "ignore"))} for w in WRONG}
#: A lead byte and a continuation byte as characters of each page.
_SEQUENCES = {w: re.compile("[{}][{}]".format(*("".join(re.escape(c) for c, b in _BYTES[w].items() if low <= b < high) for low, high in ((0xC2, 0xF5), (0x80, 0xC0))))) for w in WRONG}


def read_again(word: str, page: str) -> str | None:
    """The word in the right code page if all its non-ASCII characters are of the wrong one, else null."""
    table, out = _READINGS[page], []
    for c in word:
        now = c if c.isascii() else table.get(c)
        if now is None:
            return None
        out.append(now)
    return "".join(out)


def as_utf8(word: str) -> str | None:
    """The word whose bytes were read as UTF-8, or null if it cannot have been."""
    raw = word.encode("utf-8", "replace")
    now = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    return now if now != word and all(c in _LEGACY for c in now if not c.isascii()) else None


def readings(word: str, kind: str) -> list[tuple[str, str, list[str], bool]]:
    """(how, other, changed characters, sure) of each other way to read a word."""
    likely = repair_sequences(word)
    out = [("spans", likely, [], True)] if likely != word else []
    out += [("spans", other, [], False) for other in decoded_again(word) if other != likely]
    if kind in ("legacy", "plain"):
        for page in WRONG:
            other = read_again(word, page)
            # A letter that stands alone in plain text may be any: only signs are told by themselves.
            if other is not None and other != word and (kind == "legacy" or len(word) > 1 or not other.isalpha()):
                out.append((page, other, sorted({a for a, b in zip(word, other) if a != b}), False))
            if page != "latin-1" and _SEQUENCES[page].search(word):
                out += [(f"spans {page}", o, [], False) for o in decoded_again(word, _BYTES[page])]
        if kind == "legacy" and (other := as_utf8(word)):
            out.append(("utf-8", other, [], False))
    return out


def kind_of(text: Column, font: Column | None = None) -> Column:
    """The kind of a text: `sinhala` (Unicode), `legacy` (an FM font, or the shape of such text) or `plain`."""
    shape = text.rlike(r"[a-z][A-Z]|[A-Za-z][;<=%,.]+[;<=%]*[A-Za-z]|[a-z]@") & ~text.rlike(r"(?i)\b(?:the|which|what|that|between|of|and)\b")
    by_font = F.when(font.rlike("^(?:[A-Z]{6}\\+)?FM"), F.lit("legacy")) if font is not None else None
    by_text = F.when(text.rlike("[\u0d80-\u0dff]|à[¶·]|Ã Â"), F.lit("sinhala")).when(shape, F.lit("legacy")).otherwise(F.lit("plain"))
    return F.coalesce(by_font, by_text) if by_font is not None else by_text


#: All but ASCII and Sinhala, which no wrong decoding of a single byte gives.
_ODD = "[^\\x00-\\x7f\u0d80-\u0dff\u200d]"


def odd_words(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, word): a row for each word of (keys, kind, text) with an odd character; those in brackets are of the kind `foreign`."""
    bracketed = F.col("text").contains("[")
    bare = F.when(bracketed, F.regexp_replace("text", BRACKETED, " ")).otherwise(F.col("text"))
    odd = lambda text: F.filter(F.split(text, BETWEEN), lambda w: w.rlike(_ODD))
    foreign = F.when(bracketed, odd(F.array_join(F.regexp_extract_all("text", F.lit(f"({BRACKETED})"), F.lit(1)), " ")))
    tagged = lambda words, kind: F.transform(words, lambda w: F.struct(kind.alias("kind"), w.alias("word")))
    both = F.concat(tagged(odd(bare), F.col("kind")), F.coalesce(tagged(foreign, F.lit("foreign")), F.array()))
    return texts.select(*keys, F.explode(both).alias("w")).select(*keys, "w.kind", "w.word")


def fixes(words: DataFrame) -> DataFrame:
    """(kind, word, how, other): the words of (kind, word), a row for each occurrence, that were wrongly decoded, with what they were."""
    counted = stash(words.groupBy("kind", "word").count(), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, w, n, *r) for k, w, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "word", "count"))) for r in readings(w, k)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["kind", "word", "n", "how", "other", "changed", "sure"])

    read = counted.mapInArrow(run, "kind string, word string, n bigint, how string, other string, changed array<string>, sure boolean")
    known = counted.select("kind", F.col("word").alias("other"), F.col("count").alias("found"))
    judged = stash(read.join(known, ["kind", "other"], "left").withColumn("found", F.coalesce("found", F.lit(0))), "readings")
    # One row for each kind, code page and character of it: bounded by the code pages.
    each = judged.where("size(changed) > 0").select("kind", "how", "n", "found", F.explode("changed").alias("c"))
    explained = F.col("found") > F.col("n")
    support = each.groupBy("kind", "how", "c").agg((F.sum(F.when(explained, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.count_if(explained).alias("words"))
    least = judged.where("size(changed) > 0").select("kind", "word", "how", F.explode("changed").alias("c")).join(F.broadcast(support), ["kind", "how", "c"]).groupBy("kind", "word", "how").agg(F.min("share").alias("share"), F.min("words").alias("words"))
    rated = judged.join(least, ["kind", "word", "how"], "left")
    by_spans = F.col("how") == "spans"
    right = (
        F.when(by_spans, F.col("sure") | (F.col("found") >= F.col("n") * RATIO))
        .when((F.col("found") > F.col("n")) & (F.col("share") >= SUPPORT), True)
        .when(F.col("found") >= F.col("n") * RATIO, True)
        .otherwise((F.col("found") == 0) & (F.col("kind") == "legacy") & (F.col("share") >= FULL_SUPPORT) & (F.col("words") >= LEAST_WORDS))
    )
    # Of several right readings the most frequent one; among those that occur nowhere the deepest decoding.
    best = F.max_by(F.struct("how", "other"), F.struct("found", by_spans, F.col("sure"), -F.length("other"), F.coalesce("share", F.lit(0.0)), "how"))
    return rated.where(right).groupBy("kind", "word").agg(best.alias("b")).select("kind", "word", "b.how", "b.other")


KEY = ("rec_table", "rec_id", "field")


def wrong_words(texts: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field, kind, word, how, other): each wrongly decoded word of each text."""
    words = stash(odd_words(texts, *KEY), "odd-words")
    return words.join(stash(fixes(words), "fixes"), ["kind", "word"])


def apply_fixes(text: str, kind: str, fixed: list[dict]) -> str:
    """The text with its wrong words replaced; a code page that explains at least half of the odd words is that of all that it can be of."""
    known = {(f["kind"], f["word"]): f["other"] for f in fixed}
    parts = [_SPLIT.split(part) for part in _BRACKETED.split(text)]
    odd = {w for words in parts[::2] for w in words[::2] if not w.isascii()}
    pages = [p for p in _READINGS if 2 * sum(f["how"] == p for f in fixed) >= max(1, len(odd))]
    for i, words in enumerate(parts):
        for j in range(0, len(words), 2):
            again = known.get(("foreign" if i % 2 else kind, words[j]))
            if again is None and pages and not i % 2:
                again = read_again(words[j], pages[0])
            words[j] = words[j] if again is None else again
    return "".join(w for words in parts for w in words)


def repaired_texts(texts: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field, value, repaired) of the wrongly decoded texts among (rec_table, rec_id, field, kind, text)."""
    hits = wrong_words(texts).groupBy(*KEY).agg(F.collect_set(F.struct("kind", "word", "how", "other")).alias("fixes"))
    rows = texts.join(hits, list(KEY), "left").where(F.col("fixes").isNotNull() | F.col("text").contains("\ufffd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = [apply_fixes(t, k, f or []) for t, k, f in zip(*(batch.column(c).to_pylist() for c in ("text", "kind", "fixes")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rec_table", "rec_id", "field", "text")), pa.array(again, pa.string())], ["rec_table", "rec_id", "field", "value", "repaired"])

    return rows.select("rec_table", "rec_id", "field", "text", "kind", "fixes").mapInArrow(run, "rec_table string, rec_id bigint, field string, value string, repaired string")


def found_texts(texts: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field) of the rows of repaired_texts, without the repair."""
    return wrong_words(texts).select(*KEY).unionByName(texts.where(F.col("text").contains("\ufffd")).select(*KEY))


def _as_bytes(name: str, page: str) -> bytes | None:
    try:
        return name.encode(page)
    except UnicodeEncodeError:
        if page != "cp1252":
            return None
        raw = [ord(c) if ord(c) < 128 else _TO_BYTE.get(c, -1) for c in name]
        return None if min(raw) < 0 else bytes(raw)


def name_readings(name: str) -> list[tuple[str, bool]]:
    """(other, sure) for each other way to read a font name: spans decoded, then pairs of code pages."""
    decoded = list(decoded_again(name))
    out = {other: bool(_NAME.fullmatch(other)) for other in decoded}
    for text in (name, *decoded):
        for wrong in ("cp1252", *WRONG):
            raw = _as_bytes(text, wrong)
            for right in FONT_RIGHT if raw else ():
                try:
                    other = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if other != name and _NAME.fullmatch(other):
                    out.setdefault(other, False)
    return list(out.items())


def repaired_names(names: DataFrame, reference: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field, value, repaired) of the wrongly decoded font names among (rec_table, rec_id, field, text).

    A name of the reference is right. Another is wrong if a reading of it is a name of the reference or of twice as many
    fragments, or if its sequences decode to a name that only letters make up. A name that nothing explains stays.
    """
    bare = names.where(F.col("text").rlike("[^\\x00-\\x7f]")).withColumn("bare", F.regexp_replace("text", r"^[A-Z]{6}\+", ""))
    listed = reference.where("font IS NOT NULL").select(F.col("font").alias("bare"), F.lit(True).alias("listed")).distinct()
    counted = stash(bare.groupBy("bare").count().join(listed, "bare", "full").select("bare", F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed")), "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, n, *r) for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in name_readings(b)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], ["bare", "n", "other", "sure"])

    read = counted.where("NOT listed AND n > 0").select("bare", "n").mapInArrow(run, "bare string, n bigint, other string, sure boolean")
    known = counted.select(F.col("bare").alias("other"), F.col("n").alias("found"), "listed")
    judged = read.join(known, "other", "left").withColumns({"found": F.coalesce("found", F.lit(0)), "listed": F.coalesce("listed", F.lit(False))})
    right = judged.where("sure OR listed OR found > 2 * n").groupBy("bare").agg(F.max_by("other", F.struct("listed", "found", "sure", -F.length("other"), "other")).alias("other"))
    wrong = bare.join(right, "bare", "left").where("other IS NOT NULL OR contains(text, '\ufffd')")
    return wrong.select("rec_table", "rec_id", "field", F.col("text").alias("value"), F.coalesce("other", "bare").alias("repaired"))


def texts_of(items: DataFrame, questions: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field, kind, text) of the fragments and raw sources that hold any character but ASCII and Sinhala."""
    fragments = items.where("str IS NOT NULL").select(F.lit("positioned_item").alias("rec_table"), F.col("item_id").alias("rec_id"), F.lit("str").alias("field"), kind_of(F.col("str"), F.col("font")).alias("kind"), F.col("str").alias("text"))
    sources = questions.where("raw_legacy IS NOT NULL").select(F.lit("question").alias("rec_table"), F.col("question_id").alias("rec_id"), F.lit("raw_legacy").alias("field"), kind_of(F.col("raw_legacy")).alias("kind"), F.col("raw_legacy").alias("text"))
    return fragments.unionByName(sources).where(F.col("text").rlike(_ODD) & F.col("rec_id").isNotNull())


def names_of(items: DataFrame) -> DataFrame:
    return items.where("item_id IS NOT NULL").select(F.lit("positioned_item").alias("rec_table"), F.col("item_id").alias("rec_id"), F.lit("font").alias("field"), F.col("font").alias("text"))


def repaired(items: DataFrame, questions: DataFrame, fonts: DataFrame) -> DataFrame:
    """All wrongly decoded fragments, font names and raw sources with what they were, once each."""
    return repaired_texts(texts_of(items, questions)).unionByName(repaired_names(names_of(items), fonts)).dropDuplicates(list(KEY))


def found(items: DataFrame, questions: DataFrame, fonts: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field), once each, of all wrongly decoded values."""
    names = repaired_names(names_of(items), fonts).select("rec_table", "rec_id", "field")
    return found_texts(texts_of(items, questions)).unionByName(names).distinct()
