"""Page statistics, and the pages that they suggest for questions and for the answer sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import is_integer, trim
from quirefold.operators.cleanse import PAGE

# The markers that count, and the limits.
MARKERS = ("^1&", "^2&", "^3&", "^4&")
OCR_LEAST_ITEMS = 10
QUESTION_MARKERS, QUESTION_RATIO = 4, 0.2
ANSWER_INTEGERS, ANSWER_RATIO = 40, 0.15


def stats(items: DataFrame) -> DataFrame:
    """(session_id, page_index, items, markers, ints, ratio) of each page that holds fragments."""
    number = F.coalesce(is_integer("str"), F.lit(False))
    counted = items.groupBy(*PAGE).agg(F.count("*").alias("items"), F.count_if(trim("str").isin(*MARKERS)).alias("markers"), F.count_if(number).alias("ints"))
    return counted.withColumn("ratio", F.col("ints") / F.col("items"))


def needs_recognition(pages: DataFrame, items: DataFrame, least: int = OCR_LEAST_ITEMS) -> DataFrame:
    """(session_id, page_index, needs_ocr) for every given page, those without any fragment included."""
    counted = items.groupBy(*PAGE).agg(F.count("*").alias("n"))
    return pages.select(*PAGE).distinct().join(counted, [*PAGE], "left").select(*PAGE, (F.coalesce("n", F.lit(0)) < least).alias("needs_ocr"))


def question_pages(page_stats: DataFrame) -> DataFrame:
    return page_stats.where((F.col("markers") >= QUESTION_MARKERS) & (F.col("ratio") < QUESTION_RATIO)).select(*PAGE)


def answer_page(page_stats: DataFrame) -> DataFrame:
    """(session_id, page_index): of each session the likely answer page of the highest ratio, the first of equals."""
    likely = page_stats.where((F.col("ints") >= ANSWER_INTEGERS) & (F.col("ratio") >= ANSWER_RATIO))
    best = likely.groupBy("session_id").agg(F.max(F.struct("ratio", (-F.col("page_index")).alias("back"))).alias("b"))
    return best.select("session_id", (-F.col("b.back")).alias("page_index"))
