"""Repair of text from scanned pages: page furniture, words broken at line ends, wrongly recognised characters.

Stages, all over whole tables:

1. Lines: a scanned page's lines and a stem's lines come into one table with their neighbours. Two logistic classifiers
   on pairs of neighbouring lines tell furniture (headers, footers, page numbers), the one for page lines by place and
   shape, the one for lines inside a stem by shape alone. They are fitted on pages whose edges speak for themselves.
2. Joins: a logistic classifier on a line and the next content line tells whether the last word goes on there. It is
   fitted on lines of clean pages, as they stand, with a free dash after them, and broken inside a word by hand.
3. Lexicon: counts of the words of all clean texts (text pages, stems and options of questions that were not scanned).
4. Candidates: words of scanned content that are not in the lexicon meet lexicon words in an inverted join on character
   trigrams: all lexicon words that share any trigram with a word and are of nearly its length, however many.
5. Ranking: gradient-boosted trees score each (word, candidate) by how their spelling differs, how often such a difference
   occurs on scanned against clean pages, and how frequent the candidate is. They are fitted on a bounded sample with true
   labels: clean words into which such differences are planted, of which the clean word is the one right candidate, and
   words that occur once in clean texts, of which no candidate is right. A word is misread if its best candidate passes
   one half; that candidate replaces it.

Defined results: null and empty texts and rows without a key give nothing; a line break alone, a spaced dash and numbers are no noise; repeated
rows count once; a page or stem without content is an empty text; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import lookalike
from quirefold.llm.boosting import BoostedTrees, logistic
from quirefold.session import hashed_sample, spread, stash

#: The bounds of the training samples: page lines, and words of either class whose rows fit the trees. Counts know no bound.
SAMPLE_LINES, SAMPLE_WORDS = 20_000, 1_500
#: By how many characters a correction may be longer or shorter.
REACH = 2
#: So many lexicon words of one trigram a task may hold; the rows of a commoner one are dealt into cells.
HOT_GRAM = 100_000
#: How far the lines of a margin may lie from each other, in points.
MARGIN = 18.0
#: A line that stands off from the one before by so many times the page's usual step begins a paragraph.
PARAGRAPH = 1.3
#: A candidate must be so frequent in clean text.
LEAST_COUNT = 2

# The dashes that break words, and what is stripped from the ends of words.
DASHES = "-‐–¬"
EDGE = r"\s.,?()\[\]“”‘’:;!—\"'"
EDGES = " \t\n\v\f\r.,?()[]“”‘’:;!—\"'"
_NUMBER = r"(?:[ivxlc]{1,5}|\d{1,6})"
PAGE_NUMBER = rf"(?i)(?:[-=\[|]\s*{_NUMBER}\s*[-=\]|]|(?:\p{{L}}[\p{{L}}\p{{M}}\u200d]+\s+)?{_NUMBER}(?:\s*(?:/|of)\s*{_NUMBER})?)"
TITLE = rf".{{3,80}}\s[-–—]\s(?:\p{{L}}[\p{{L}}\p{{M}}]*\s)?{_NUMBER}(?:\s+{PAGE_NUMBER.replace('(?i)', '')}|\s*\|\s*{_NUMBER})?"


def page_lines(lines: DataFrame) -> DataFrame:
    """(tab, id, sub, unit, text, gap_above, gap_below, from_top, at_edge): the lines of scanned pages with their places."""
    once = lines.where("source = 'ocr' AND line_id IS NOT NULL").groupBy("line_id").agg(*(F.min(c).alias(c) for c in ("session_id", "page_index", "line_idx", "text", "y")))
    page = Window.partitionBy("session_id", "page_index").orderBy("line_idx", "line_id")
    placed = once.withColumns({"above": F.lag("y").over(page), "below": F.lead("y").over(page)})
    return placed.select(
        F.lit("text_line").alias("tab"), F.col("line_id").alias("id"), F.lit(0).alias("sub"),
        F.concat_ws("/", "session_id", "page_index").alias("unit"), F.col("line_idx").alias("ord"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("above") - F.col("y"), F.lit(0.0)).alias("gap_above"), F.coalesce(F.col("y") - F.col("below"), F.lit(0.0)).alias("gap_below"),
        "y", (F.col("above").isNull() | F.col("below").isNull()).alias("at_edge"),
    )


def stem_lines(questions: DataFrame) -> DataFrame:
    """The lines of stems in the columns of page_lines; at_edge are the first and the last line of a stem.

    Stems come in their consistent form, so that look-alike characters are not taken for misread ones.
    """
    narrow = spread(questions.select(F.col("question_id").alias("key"), "stem"))
    shape = f"CASE WHEN regexp_matches(stem, '{lookalike.SUSPECT}') THEN {lookalike.form_sql('stem')} ELSE stem END"
    formed = lookalike.map_sql(narrow, f"SELECT key, {shape} AS stem FROM batch WHERE stem IS NOT NULL AND key IS NOT NULL", "key bigint, stem string")
    split = formed.groupBy("key").agg(F.min("stem").alias("stem")).select("key", F.split("stem", "\n").alias("l"))
    rows = split.select("key", F.size("l").alias("n"), F.posexplode("l").alias("sub", "text"))
    return rows.select(
        F.lit("question").alias("tab"), F.col("key").alias("id"), "sub", F.concat(F.lit("q"), F.col("key")).alias("unit"), F.col("sub").alias("ord"), "text",
        F.lit(0.0).alias("gap_above"), F.lit(0.0).alias("gap_below"), F.lit(0.0).alias("y"), ((F.col("sub") == 0) | (F.col("sub") == F.col("n") - 1)).alias("at_edge"),
    )


def _shape(text: Column) -> list[Column]:
    """What the wording of a line says of it."""
    bare = F.trim(text)
    words = F.size(F.split(bare, r"\s+"))
    return [
        bare.rlike(f"^{PAGE_NUMBER}$").cast("double"),
        bare.rlike(f"^{TITLE}$").cast("double"),
        bare.rlike(r"\(\s*\d\s*\)").cast("double"),
        F.least(words, F.lit(15)).cast("double"),
    ]


def _place() -> list[Column]:
    return [F.col("text").rlike(r"^\s*\d{2,4}\s*$").cast("double"), F.least("gap_above", F.lit(60.0)), F.least("gap_below", F.lit(60.0)), F.col("at_edge").cast("double"), F.col("edge_y")]


def _linear(features: list[Column], fitted: tuple[np.ndarray, float]) -> Column:
    out = F.lit(fitted[1])
    for column, weight in zip(features, fitted[0].tolist()):
        out = out + column * F.lit(weight)
    return out


def with_furniture(pages: DataFrame, stems: DataFrame) -> DataFrame:
    """Both tables of lines in one, with a column `furniture`."""
    pages = stash(pages, "page-lines")
    # Where the margins lie: quantiles, so that single misplaced lines do not move them. A line without height is in none.
    bottom, top = (pages.agg(F.percentile_approx("y", [0.005, 0.995])).first()[0] or [0.0, 0.0])
    margin = (F.least(F.lit(top) - F.col("y"), F.col("y") - F.lit(bottom)) < MARGIN).cast("double")
    pages = pages.withColumn("edge_y", F.coalesce(margin, F.lit(0.0)))
    shape, place = _shape(F.col("text")), _place()
    # Lines at a page edge, set off from the rest in the margin, are furniture; lines between two near ones are content.
    sure = F.when(F.col("at_edge") & (F.col("edge_y") == 1) & (F.greatest("gap_above", "gap_below") > 20), 1.0).when(~F.col("at_edge") & (F.col("edge_y") == 0), 0.0)
    features = [f.alias(f"f{i}") for i, f in enumerate([*shape, *place])]
    sample = hashed_sample(pages.withColumn("sure", sure).where("sure IS NOT NULL"), "id", SAMPLE_LINES).select("sure", *features).toPandas()
    x, y = sample.iloc[:, 1:].to_numpy(float), sample["sure"].to_numpy(float)
    if len(set(y)) < 2:
        by_place = by_shape = (np.zeros(len(features)), -1.0)
    else:
        by_place, by_shape = logistic(x, y), logistic(x[:, : len(shape)], y)
    pages = pages.withColumn("furniture", _linear([*shape, *place], by_place) > 0).drop("edge_y")
    stems = stems.withColumn("furniture", ~F.col("at_edge") & (_linear(shape, by_shape) > 0))
    return pages.unionByName(stems)


def _join_features(text: Column, following: Column) -> list[Column]:
    """What the end of a line and the start of the next content line say of a word between them."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        yes(text.rlike(rf"[\p{{L}}\p{{M}}\u200d©®\d!][{DASHES}]\s*$")),
        yes(text.rlike(r"\s[-‐–—¬]\s*$")),
        yes(following.rlike(r"^\s*[\p{Ll}\p{Lo}\p{M}]")),
        yes(following.rlike(r"^\s*(?:[\p{Lu}\d(])")),
    ]


def fit_joins(lines: DataFrame) -> tuple[np.ndarray, float]:
    """The classifier of line pairs, fitted on about SAMPLE_LINES lines of clean pages; whole pages, drawn by hash."""
    clean = lines.where("source <> 'ocr' AND text IS NOT NULL AND line_id IS NOT NULL").select("session_id", "page_index", "line_idx", "line_id", "text")
    share = min(1.0, SAMPLE_LINES / max(1, clean.count()))
    some = clean.where(F.pmod(F.xxhash64("session_id", "page_index"), F.lit(1 << 30)) < int(share * (1 << 30)))
    page = Window.partitionBy("session_id", "page_index").orderBy("line_idx", "line_id")
    pairs = some.withColumn("following", F.lead("text").over(page)).where("following IS NOT NULL")
    parts = F.split("text", " ")
    draw = lambda salt, n: F.pmod(F.xxhash64("line_id", F.lit(salt)), n).cast("int")
    cut = pairs.select("line_id", "text", "following", parts.alias("parts"), draw(1, F.size(parts)).alias("at")).withColumn("word", F.get("parts", F.col("at")))
    dash = F.get(F.array(*map(F.lit, DASHES[:2])), draw(2, F.lit(2)))
    head = F.array_join(F.concat(F.slice("parts", F.lit(1), F.col("at")), F.array(F.concat(F.expr("substring(word, 1, length(word) div 2)"), dash))), " ")
    tail = F.array_join(F.concat(F.array(F.expr("substring(word, length(word) div 2 + 1)")), F.slice("parts", F.col("at") + 2, F.size("parts"))), " ")
    broken = cut.where(F.col("word").rlike(r"^[\p{L}\p{M}\u200d]{5,}$")).select(head.alias("text"), tail.alias("following"), F.lit(1.0).alias("y"))
    free = pairs.select(F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, "-–—")), draw(3, F.lit(3)))).alias("text"), "following", F.lit(0.0).alias("y"))
    sample = pairs.select("text", "following", F.lit(0.0).alias("y")).unionByName(free).unionByName(broken)
    rows = sample.groupBy("y", *(f.alias(f"f{i}") for i, f in enumerate(_join_features(F.col("text"), F.col("following"))))).count().toPandas()
    if set(rows["y"]) != {0.0, 1.0}:
        # Nothing clean to learn from: an attached dash joins.
        return np.array([2.0, 0.0, 0.0, 0.0]), -1.0
    times = rows["count"].to_numpy()
    x = np.repeat(rows.filter(regex="^f").to_numpy(float), times, axis=0)
    return logistic(x, np.repeat(rows["y"].to_numpy(float), times))


def tokens(lines: DataFrame, joins: tuple[np.ndarray, float]) -> DataFrame:
    """(tab, id, sub, unit, ord, pos, raw, word, broken): the words of content lines, a broken word whole in its first line.

    `broken` is the length of the part of the word before the line end, null for a whole word; the rest of it is left
    out of the next line. `word` is the raw word in lower case without the marks at its ends.
    """
    content = lines.where("NOT furniture")
    order = Window.partitionBy("unit").orderBy("ord", "id")
    # A number alone on a line stands between the parts of a broken word, but is none of them.
    lone = F.col("text").rlike(r"^[^\p{L}]*$")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    # What comes after, as what came before in the opposite order: a frame that ends with the unit is read again for each line.
    ahead = Window.partitionBy("unit").orderBy(F.desc("ord"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    marked = content.withColumn("lone", lone).withColumn("next", F.last(F.when(~F.col("lone"), F.col("text")), ignorenulls=True).over(ahead))
    judged = marked.withColumn("ends", ~F.col("lone") & (_linear(_join_features(F.col("text"), F.col("next")), joins) > 0))
    linked = judged.withColumn("went_on", ~F.col("lone") & F.coalesce(F.last(F.when(~F.col("lone"), F.col("ends")), ignorenulls=True).over(behind), F.lit(False)))
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    kept = F.when(F.col("went_on"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    # What is said of a line stands in a selection of its own, or the planner says it again for each word.
    whole = linked.select("tab", "id", "sub", "unit", "ord", "ends", F.regexp_extract("next", r"^\s*(\S+)", 1).alias("rest"), kept.alias("kept")).withColumn("n", F.size("kept"))
    listed = whole.select("tab", "id", "sub", "unit", "ord", "ends", "rest", "n", F.posexplode("kept").alias("pos", "raw"))
    last = F.col("ends") & (F.col("pos") == F.col("n") - 1)
    stub = F.regexp_replace("raw", rf"[{DASHES}]$", "")
    joined = listed.select("tab", "id", "sub", "unit", "ord", "pos", F.when(last, F.concat(stub, F.coalesce("rest", F.lit("")))).otherwise(F.col("raw")).alias("raw"), F.when(last, F.length(stub)).alias("broken"))
    return joined.withColumn("word", F.lower(F.btrim("raw", F.lit(EDGES))))


def lexicon(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """(word, count) over all clean texts."""
    scanned = F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "ocr")
    texts = lines.where("source <> 'ocr'").select("text").unionByName(questions.where(~scanned).select(F.concat_ws(" ", "stem", F.array_join("options", " ")).alias("text")))
    # Counted as they stand first: each distinct piece is stripped once. A condition that asks for the count stays behind it.
    pieces = texts.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).groupBy("w").count()
    words = pieces.select(F.btrim("w", F.lit(EDGES)).alias("word"), "count").where(F.when(F.col("count") > 0, F.col("word").rlike(r"\p{L}")))
    return words.groupBy("word").agg(F.sum("count").alias("count"))


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))


def inverted(known: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(candidate, count, gram): a row for each trigram of each lexicon word that is frequent enough."""
    return known.where(F.col("count") >= least_count).select(F.col("word").alias("candidate"), "count", F.explode(F.array_distinct(_grams(F.col("word")))).alias("gram"))


def candidates(unknown: DataFrame, index: DataFrame, probes: int | None = None, reach: int = REACH, hot: int = HOT_GRAM) -> DataFrame:
    """(word, scanned, candidate, count): lexicon words that share trigrams with a word and are of nearly its length.

    A word is looked up by all its trigrams, and one shared trigram is enough: every word of the index within `reach` that
    shares any trigram is found. With `probes` it is looked up by so many of its rarest, and a long one must share two of them.
    A trigram of more than `hot` lexicon words is split: its words are dealt into cells, and what asks for it asks in each.
    """
    looked = unknown.select("word", "scanned", F.explode(F.array_distinct(_grams(F.col("word")))).alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("df"))
    looked = looked.join(df, "gram")
    if probes is not None:
        rarity = Window.partitionBy("word", "scanned").orderBy("df", "gram")
        looked = looked.withColumn("r", F.row_number().over(rarity)).where(F.col("r") <= probes)
    parts = F.ceil(F.col("df") / hot).cast("int")
    asked = looked.select("word", "scanned", "gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("cell"))
    split = index.join(df.where(F.col("df") > hot).select("gram", parts.alias("parts")), "gram", "left")
    dealt = split.select("candidate", "count", "gram", F.coalesce(F.pmod(F.hash("candidate"), "parts"), F.lit(0)).alias("cell"))
    near = (F.abs(F.length("word") - F.length("candidate")) <= reach) & (F.col("word") != F.col("candidate"))
    met = asked.join(dealt, ["gram", "cell"]).where(near).groupBy("word", "scanned", "candidate", "count").agg(F.count("*").alias("shared"))
    # Sharing more than one trigram, unless the word is short, removes most chance meetings before anything is scored.
    kept = met if probes is None else met.where((F.col("shared") > 1) | (F.length("word") <= 6))
    return kept.drop("shared")


def differences(word: str, other: str) -> list[tuple[str, str]]:
    """The segments in which two words differ, between their longest common pieces."""
    a, b = 0, 0
    while a < min(len(word), len(other)) and word[a] == other[a]:
        a += 1
    while b < min(len(word), len(other)) - a and word[len(word) - 1 - b] == other[len(other) - 1 - b]:
        b += 1
    x, y = word[a : len(word) - b], other[a : len(other) - b]
    if min(len(x), len(y)) < 3:
        return [(x, y)]
    for size in range(min(len(x), len(y)) - 1, 0, -1):
        for i in range(1, len(x) - size + 1):
            j = y.find(x[i : i + size])
            if j > 0 or (j == 0 and i == 0):
                return [(x[:i], y[:j]), *differences(x[i + size :], y[j + size :])]
    return [(x, y)]


def _codes(words: list[str], width: int) -> np.ndarray:
    """The characters of words as numbers, a column of `width` for each word, filled up with zeros."""
    return np.ascontiguousarray(np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).T)


def _pick(codes: np.ndarray, column: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The characters of columns at places; at a place outside a column is anything."""
    return codes.ravel().take(places * codes.shape[1] + column, mode="clip")


def _leading(same: np.ndarray) -> np.ndarray:
    """How many values of each column are true before the first that is not."""
    return np.logical_and.accumulate(same, axis=0).sum(axis=0)


def _segments(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(column, lengths in the one and the other, places in the one and the other): what `differences` says of many pairs at once.

    x and y are the characters of the words, n and m their lengths. Each step gives the next segment of each pair that is left.
    """
    column, from_x, from_y, to_x, to_y = np.arange(len(n)), np.zeros(len(n), int), np.zeros(len(n), int), n, m
    while len(column):
        shorter = np.minimum(to_x - from_x, to_y - from_y)
        at = np.arange(max(1, int(shorter.max())))[:, None]
        alike = _leading((_pick(x, column, from_x + at) == _pick(y, column, from_y + at)) & (at < shorter))
        from_x, from_y = from_x + alike, from_y + alike
        alike = _leading((_pick(x, column, to_x - 1 - at) == _pick(y, column, to_y - 1 - at)) & (at < shorter - alike))
        to_x, to_y = to_x - alike, to_y - alike
        size, i, j = (np.zeros(len(column), int) for _ in range(3))
        long = np.flatnonzero(np.minimum(to_x - from_x, to_y - from_y) >= 3)
        if len(long):
            left = []
            for codes, start, end, none in ((x, from_x[long], to_x[long], 0), (y, from_y[long], to_y[long], 1 << 31)):
                at = np.arange(int((end - start).max()))[:, None]
                left.append(np.where(at < end - start, _pick(codes, column[long], start + at), np.uint32(none)))
            size[long], i[long], j[long] = _common(*left, np.minimum(to_x - from_x, to_y - from_y)[long] - 1)
        more = size > 0
        yield column, np.where(more, i, to_x - from_x), np.where(more, j, to_y - from_y), from_x, from_y
        column, from_x, from_y, to_x, to_y = column[more], (from_x + i + size)[more], (from_y + j + size)[more], to_x[more], to_y[more]


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, i, j) of the longest piece that splits x and y, the first of several, as `differences` looks for it; size 0 is none.

    A piece has at most `most` characters, begins behind the first one of x, and is none if y begins with it. What fills up x
    and what fills up y differ.
    """
    best, at_i, at_j = (np.zeros(len(most), int) for _ in range(3))
    most = most.astype(np.int8)
    # How long x from i and y from j agree: from the end, each by the one behind it.
    run = np.zeros((len(y) + 1, len(most)), np.int8)
    for i in range(len(x) - 1, 0, -1):
        run[:-1] = (run[1:] + 1) * (y == x[i])
        size = np.minimum(run[1:].max(axis=0), most)
        better = np.flatnonzero((size > run[0]) & (size >= best))
        best[better], at_i[better] = size[better], i
        at_j[better] = np.argmax(run[:, better] >= size[better], axis=0)
    return best, at_i, at_j


#: Pairs of words up to so many characters are compared at once; those with longer ones, of which there are few, one by one.
TOGETHER = (8, 11, 14, 18, 24, 32, 64)


def compared(words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(pair, length in the word, length in the other, text in the word, text in the other): the segments of `differences`
    of each pair, in order; the texts of a segment of more than three characters are anything."""
    n, m = (np.fromiter(map(len, side), int, len(side)) for side in (words, others))
    # A zero is what fills up the columns of characters.
    longest = np.where([("\0" in w or "\0" in o) for w, o in zip(words, others)], TOGETHER[-1] + 1, np.maximum(n, m)).astype(int)
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), pa.array([], pa.string()), pa.array([], pa.string()))]
    for least, most in zip((-1, *TOGETHER), TOGETHER):
        rows = np.flatnonzero((longest > least) & (longest <= most))
        if len(rows):
            x, y = (_codes([side[k] for k in rows], most) for side in (words, others))
            for column, size_x, size_y, at_x, at_y in _segments(x, n[rows], y, m[rows]):
                texts = [_texts(codes, column, at, size) for codes, at, size in ((x, at_x, size_x), (y, at_y, size_y))]
                parts.append((rows[column], size_x, size_y, *texts))
    single = [(k, x, y) for k in np.flatnonzero(longest > TOGETHER[-1]).tolist() for x, y in differences(words[k], others[k])]
    if single:
        at, x, y = zip(*single)
        parts.append((np.array(at), np.array([*map(len, x)]), np.array([*map(len, y)]), pa.array(x, pa.string()), pa.array(y, pa.string())))
    pair, size_x, size_y, *texts = zip(*parts)
    order = np.argsort(pair := np.concatenate(pair), kind="stable")
    return pair[order], np.concatenate(size_x)[order], np.concatenate(size_y)[order], *(pa.concat_arrays(t).take(pa.array(order)) for t in texts)


def _texts(codes: np.ndarray, column: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The texts of segments of at most three characters; of longer ones the first three."""
    k = np.arange(3)[:, None]
    three = np.where(k < size, _pick(codes, column, at + k), np.uint32(0))
    return pa.array(np.ascontiguousarray(three.T).view("U3").ravel(), pa.string())


_DIGITS = np.array([c for c in range(0x110000) if chr(c).isdigit()])


def _scripts(codes: np.ndarray) -> np.ndarray:
    """0 for Latin, 1 for Sinhala, 2 for digits, 3 for all else."""
    sinhala = ((codes >= 0x0D80) & (codes <= 0x0DFF)) | (codes == 0x200D)
    return np.select([(codes >= ord("a")) & (codes <= ord("z")), sinhala, np.isin(codes, _DIGITS)], [0, 1, 2], 3)


def _foreign(words: list[str], others: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """By how many characters of another script than the main one of the other word a word has more than the other."""
    scripts = []
    for side, size in ((words, n), (others, m)):
        codes = _codes(side, max(1, int(size.max())))
        scripts.append((_scripts(codes), np.arange(len(codes))[:, None] < size, (codes == ord("'")) | (codes == ord("-"))))
    kind, inside, _ = scripts[1]
    main = np.where(m > 0, kind[np.argmax((kind < 2) & inside, axis=0), np.arange(len(m))], 0)
    ours, theirs = (((kind != main) & inside & ~mark).sum(axis=0) for kind, inside, mark in scripts)
    return ours - theirs


def with_edits(pairs: DataFrame) -> DataFrame:
    """The pairs with `edits`, the differences between word and candidate; a long one, which is never counted, is null.

    `shape` holds what else is said of all of them: the characters changed, 31 bits of the most that one grows or shrinks,
    a bit that is set if one is empty on a side. `foreign` are the characters of another script that the word has more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("a", pa.string()), ("b", pa.string())])
        for batch in batches:
            if not batch.num_rows:
                continue
            words, others = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            n, m = (np.fromiter(map(len, side), int, len(side)) for side in (words, others))
            pair, x, y, a, b = compared(words, others)
            first = np.searchsorted(pair, np.arange(len(words) + 1))
            each = pa.StructArray.from_arrays([a, b], fields=list(kind), mask=pa.array(np.maximum(x, y) > 3))
            edits = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), each)
            over = lambda kind, values: kind.reduceat(values, first[:-1])
            changed, uneven, empty = over(np.add, np.maximum(x, y)), over(np.maximum, np.abs(x - y)), over(np.maximum, (x == 0) | (y == 0))
            more = pa.array(changed << 32 | uneven << 1 | empty), pa.array(_foreign(words, others, n, m).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, edits], ["word", "scanned", "candidate", "count", "shape", "foreign", "edits"])

    schema = "word string, scanned boolean, candidate string, count bigint, shape bigint, foreign int, edits array<struct<a: string, b: string>>"
    return pairs.select("word", "scanned", "candidate", "count").mapInArrow(run, schema)


#: What the trees are told of a pair, in the order of with_ratios and `features`.
TOLD = ("count", "least", "total", "parts", "shape", "foreign", "length")


def features(batch: pa.RecordBatch) -> np.ndarray:
    """A row for each pair of a batch of TOLD: what a replacement changes, and how often such changes occur among scanned against clean words: least and sum of their ratios."""
    count, least, total, parts, shape, foreign, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(TOLD)))
    changed, uneven, empty = shape >> 32, shape >> 1 & (1 << 31) - 1, shape & 1
    return np.stack([least, total, parts, changed, changed / np.maximum(1, length), foreign, np.log(count), length, uneven, empty], axis=1).astype(float)


def edit_ratios(edited: DataFrame) -> DataFrame:
    """(a, b, n, ratio): in how many scanned words a single short difference occurs, and by how much more than in clean ones, as a logarithm.

    Counted over all pairs of all words, of clean ones those that occur once; the counts of the clean words are scaled to
    the number of scanned ones. A difference that occurs in a single word says nothing of others and counts as none.
    """
    single = edited.where((F.size("edits") == 1) & F.col("edits")[0].isNotNull()).select("word", "scanned", F.col("edits")[0]["a"].alias("a"), F.col("edits")[0]["b"].alias("b")).distinct()
    repeated = lambda which: F.when(F.count_if(which) > 1, F.count_if(which)).otherwise(0)
    counted = single.groupBy("a", "b").agg(repeated(F.col("scanned")).alias("n"), repeated(~F.col("scanned")).alias("clean")).where("n > 0 OR clean > 0")
    total = {r["scanned"]: r["n"] for r in edited.groupBy("scanned").agg(F.count_distinct("word").alias("n")).collect()}
    bias = max(1, total.get(True, 1)) / max(1, total.get(False, 1))
    return counted.select("a", "b", "n", F.log((F.col("n") + 0.5) / (F.col("clean") * F.lit(bias) + 0.5)).alias("ratio"))


def with_ratios(edited: DataFrame, ratios: DataFrame) -> DataFrame:
    """(word, scanned, candidate, *TOLD): the number, the least and the sum of the ratios of a pair's differences, 0 for those that are not counted."""
    each = edited.select("word", "scanned", "candidate", "count", "shape", "foreign", F.explode("edits").alias("e")).select("*", "e.a", "e.b").drop("e").join(ratios, ["a", "b"], "left")
    ratio = F.coalesce("ratio", F.lit(0.0))
    rated = each.groupBy("word", "scanned", "candidate", "count", "shape", "foreign").agg(F.min(ratio).alias("least"), F.sum(ratio).alias("total"), F.count("*").alias("parts"))
    return rated.withColumn("length", F.length("word")).select("word", "scanned", "candidate", *TOLD)


def planted(known: DataFrame, ratios: DataFrame, most: int) -> DataFrame:
    """(word, truth): clean words, at most so many, drawn by hash, with a difference of scanning planted in them, in one of four words two.

    A difference is drawn in proportion to how often it occurs. The clean word is the truth; what is a clean word itself
    is left out. Only the drawn words meet the differences, by their own substrings.
    """
    drawn = known.where((F.col("count") >= LEAST_COUNT) & (F.length("word") >= 4)).orderBy(F.xxhash64("word"), "word").limit(most).select(F.col("word").alias("truth"))
    spots = drawn.select("truth", F.explode(F.sequence(F.lit(1), F.length("truth"))).alias("i")).select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("n"))
    pieces = spots.where(F.col("i") + F.col("n") <= F.length("truth") + 1).withColumn("b", F.expr("substring(truth, i, n)"))
    uniform = (F.pmod(F.xxhash64("truth", "i", "a", "b"), F.lit(1 << 30)) + 1) / F.lit((1 << 30) + 1)
    met = pieces.join(ratios.where("ratio > 0 AND n > 0").select("a", "b", F.col("n").alias("often")), "b")
    each = met.select("truth", F.struct((-F.log(uniform) / F.col("often")).alias("w"), "i", "n", "a").alias("e"))
    two = each.groupBy("truth").agg(F.slice(F.array_sort(F.collect_list("e")), 1, 2).alias("e"))
    put = lambda text, e: F.concat(F.substring(text, F.lit(1), e["i"] - 1), e["a"], F.substring(text, e["i"] + e["n"], F.length(text)))
    one, more, truth = F.get("e", 0), F.get("e", 1), F.col("truth")
    second = F.when(F.pmod(F.xxhash64("truth", F.lit(4)), F.lit(4)) == 0, F.when(more["i"] >= one["i"] + one["n"], put(put(truth, more), one)).when(more["i"] + more["n"] <= one["i"], put(put(truth, one), more)))
    made = two.select(F.coalesce(second, put(truth, one)).alias("word"), "truth").groupBy("word").agg(F.min("truth").alias("truth"))
    return made.join(known.select("word"), "word", "left_anti")


class Ranker:
    """The fitted trees; small, and sent to the tasks with the plan."""

    def __init__(self, rows: DataFrame):
        """Rows are (*TOLD, whether the candidate is right); only numbers reach the driver."""
        names = [f"f{i}" for i in range(10)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*map(pa.array, features(batch).T), batch.column(len(TOLD)).cast(pa.float64())], [*names, "right"])

        schema = ", ".join(f"{n} double" for n in (*names, "right"))
        table = rows.select(*TOLD, "right").mapInArrow(run, schema).toArrow()
        *x, y = (table.column(n).to_numpy() for n in (*names, "right"))
        # Rows come in any order, and sums are made in one. Spark would make the rows twice to sort them.
        order = np.lexsort([*x, y])
        self.trees = BoostedTrees().fit(np.stack(x, axis=1)[order], y[order])

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        """The probability that each replacement in a batch of TOLD is right."""
        return self.trees.predict(features(batch))


def corrections(found: DataFrame, lines: DataFrame, questions: DataFrame) -> DataFrame:
    """(word, fixed, same): unknown words of scanned content, their replacement and the length of their common start."""
    known = stash(lexicon(lines, questions), "lexicon")
    index = stash(inverted(known), "trigrams")
    unknown = found.where(F.col("word").rlike(r"\p{L}")).select("word").distinct().join(known.select("word"), "word", "left_anti").withColumn("scanned", F.lit(True))
    rare = known.where("count = 1").select("word").withColumn("scanned", F.lit(False))
    edited = stash(with_edits(candidates(unknown.unionByName(rare), index)), "candidates")
    ratios = stash(edit_ratios(edited), "ratios")
    # Written once: the sums are made in the order of one run, and the trees and the scores see the same.
    pairs = stash(with_ratios(edited, ratios), "rated")
    made = stash(planted(known, ratios, SAMPLE_WORDS), "planted")
    shown = with_ratios(with_edits(candidates(made.select("word", F.lit(True).alias("scanned")), index)), ratios).join(made, "word")
    right = shown.select(*TOLD, (F.col("candidate") == F.col("truth")).alias("right"))
    clean = pairs.where("NOT scanned").select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS)
    wrong = pairs.where("NOT scanned").join(F.broadcast(clean), "word").select(*TOLD, F.lit(False).alias("right"))
    ranker = Ranker(right.unionByName(wrong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("candidate"), pa.array(ranker.score(batch), pa.float64())], ["word", "fixed", "score"])

    scored = pairs.where("scanned").select(*TOLD, "word", "candidate").mapInArrow(run, "word string, fixed string, score double")
    top = scored.where("score > 0.5").groupBy("word").agg(F.max_by("fixed", F.struct("score", "fixed")).alias("fixed"))
    # Numbers, of which no lexicon is kept: letters that look like digits among digits.
    numbers = unknown.where(F.col("word").rlike(r"^[lo]*[0-9][0-9lo]*$")).select("word", F.translate("word", "lo", "10").alias("fixed"))
    top = top.join(numbers.select("word"), "word", "left_anti").unionByName(numbers)
    same = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring("word", i, F.lit(1)) == F.substring("fixed", i, F.lit(1))), i).otherwise(n))
    return top.withColumn("same", same)


class Repair:
    """The stages over a pair of tables; the written tables of lines and words serve both results."""

    def __init__(self, lines: DataFrame, questions: DataFrame):
        self.lines = stash(with_furniture(page_lines(lines), stem_lines(questions)), "lines")
        self.tokens = stash(tokens(self.lines, fit_joins(lines)), "tokens")
        self.corrections = stash(corrections(self.tokens, lines, questions), "corrections")

    def found(self) -> DataFrame:
        """(rec_table, rec_id, noise), once each."""
        furniture = self.lines.where("furniture").select("tab", "id", F.lit("furniture").alias("noise"))
        broken = self.tokens.where("broken IS NOT NULL").select("tab", "id", F.lit("hyphen").alias("noise"))
        # A broken word that is wrong in its second part is a fault of the next content line of its unit.
        order = Window.partitionBy("unit").orderBy("ord", "id")
        after = self.lines.where(~F.col("furniture") & F.col("text").rlike(r"\p{L}")).select("tab", F.col("id").alias("id"), "sub", F.lead("id").over(order).alias("next_id"))
        wrong = self.tokens.join(self.corrections, "word")
        here = wrong.where("broken IS NULL OR same < broken").select("tab", "id", F.lit("misread").alias("noise"))
        there = wrong.where("broken IS NOT NULL AND same >= broken").join(after, ["tab", "id", "sub"]).select("tab", F.coalesce("next_id", "id").alias("id"), F.lit("misread").alias("noise"))
        return furniture.unionByName(broken).unionByName(here).unionByName(there).distinct().select(F.col("tab").alias("rec_table"), F.col("id").alias("rec_id"), "noise")

    def texts(self) -> DataFrame:
        """(rec_table, unit, text): each scanned page and each stem as continuous, corrected text, a line for each paragraph.

        A paragraph begins where a line stands off from the one before by more than the page's usual step.
        """
        core = F.regexp_extract("raw", rf"^[{EDGE}]*", 0), F.regexp_extract("raw", rf"[{EDGE}]*$", 0)
        fixed = self.tokens.join(self.corrections.select("word", "fixed"), "word", "left")
        bare = F.regexp_replace("raw", rf"^[{EDGE}]+|[{EDGE}]+$", "")
        cased = F.when(bare.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"), F.upper("fixed")).when(bare.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("fixed", 1, 1)), F.expr("substring(fixed, 2)"))).otherwise(F.col("fixed"))
        shown = F.when(F.col("fixed").isNull(), F.col("raw")).otherwise(F.concat(core[0], cased, core[1]))
        words = fixed.groupBy("tab", "unit", "id", "sub").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("w")))).alias("words"))
        placed = self.lines.join(words, ["tab", "unit", "id", "sub"], "left")
        line = F.array_join(F.transform("words", lambda p: p["w"]), " ")
        parts = F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("ord", "id", "sub", "gap_above", line.alias("w")))))
        step = F.percentile_approx(F.when(~F.col("furniture") & (F.col("gap_above") > 0), F.col("gap_above")), 0.5)
        pages = placed.groupBy("tab", "unit").agg(parts.alias("parts"), step.alias("step"))
        joined = F.aggregate("parts", F.lit(""), lambda text, p: F.when(text == "", p["w"]).otherwise(F.concat(text, F.when(p["gap_above"] > F.col("step") * PARAGRAPH, F.lit("\n")).otherwise(F.lit(" ")), p["w"])))
        return pages.select(F.col("tab").alias("rec_table"), "unit", joined.alias("text"))
