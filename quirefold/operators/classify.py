"""Kinds and flags of questions, and which of them an image overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE, WS, trim
from quirefold.operators.cleanse import PAGE

# The words of a stem that point at a picture or table, and the patterns of enumerations.
FIGURE_WORDS = ("රූපය", "රූපයේ", "සිතියම", "සිතියමේ", "වගුව", "වගුවේ", "ප්\u200dරස්තාරය")
LETTERS_ONLY = rf"(?i)^[A-E](?:{WS}*(?:හා|යා|සහ|,|and)?{WS}*[A-E])*\z"
ENUMERATION = rf"(?s)(?:^|{WS})A{WS}+[^{SPACE}]+.*(?:^|{WS})B{WS}+[^{SPACE}]+"
STRAIGHT_OPTIONS = (4, 5)


def _meets(q, i) -> Column:
    return (q("x") < i("x") + i("w")) & (i("x") < q("x") + q("w")) & (q("y") - q("h") < i("y")) & (i("y") - i("h") < q("y"))


def overlapping(questions: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """The keys of the questions whose box strictly overlaps an image of their page; y is the top of either box.

    An equi-join on the page with the overlap as a residual; a null coordinate overlaps nothing.
    """
    q, i = questions.select(key, *PAGE, *"xywh").alias("q"), images.select(*PAGE, *"xywh").alias("i")
    meets = _meets(lambda c: F.col(f"q.{c}"), lambda c: F.col(f"i.{c}"))
    return q.join(i, (F.col("q.session_id") == F.col("i.session_id")) & (F.col("q.page_index") == F.col("i.page_index")) & meets, "left_semi").select(key)


def kind(stem: Column, options: Column, overlaps: Column) -> Column:
    """`special`, `figure` or `straight`; null options count as none, and what is not straight in number is special."""
    special = ~F.coalesce(F.size(options).isin(*STRAIGHT_OPTIONS), F.lit(False)) | F.coalesce(F.exists(options, lambda o: trim(o).rlike(LETTERS_ONLY)), F.lit(False)) | F.coalesce(stem.rlike(ENUMERATION), F.lit(False))
    shown = F.lit(False)
    for word in FIGURE_WORDS:
        shown = shown | F.coalesce(stem.contains(word), F.lit(False))
    return F.when(special, F.lit("special")).when(shown | overlaps, F.lit("figure")).otherwise(F.lit("straight"))


def classify(questions: DataFrame, images: DataFrame) -> DataFrame:
    """The questions with `kind`; boxes are x, y, w, h.

    The images of a page, which are few, come as one array, so that the questions' plan is used once.
    """
    boxes = images.groupBy(*PAGE).agg(F.collect_list(F.struct(*"xywh")).alias("_boxes"))
    hit = F.exists("_boxes", lambda b: F.coalesce(_meets(F.col, lambda c: b[c]), F.lit(False)))
    return questions.join(boxes, [*PAGE], "left").withColumn("kind", kind(F.col("stem"), F.col("options"), F.coalesce(hit, F.lit(False)))).drop("_boxes")


def flags(unmapped: Column, scanned: Column) -> Column:
    """The array of flags: unmapped-glyph before ocr."""
    return F.filter(F.array(F.when(unmapped > 0, F.lit("unmapped-glyph")), F.when(scanned, F.lit("ocr"))), lambda f: f.isNotNull())
