"""Fragments of a page: blank and repeated text out, recognised words in page coordinates, legacy text converted.

Null texts count as blank; a repeated delivery of a fragment counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import legacy
from quirefold.functions.text import trim

PAGE = ("session_id", "page_index")
#: A text of at least LEAST_LENGTH characters that stands at least MIN_REPEATS times on a page is a watermark.
MIN_REPEATS, LEAST_LENGTH = 4, 12
OCR_SCALE = 4.0


def once(df: DataFrame, key: str, together: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table without repeated deliveries: of each key the first that was loaded; rows without a key go.

    With `together`, columns on which deliveries of a key agree, rows are partitioned by those and the aggregate runs
    inside, so that windows and groups over the same columns need no further shuffle.
    """
    if together:
        df = df.repartition(*together)
    others = [c for c in df.columns if c not in (key, "loaded_at", *together)]
    first = [F.col("loaded_at")] if "loaded_at" in df.columns else []
    return df.where(F.col(key).isNotNull()).groupBy(*together, key).agg(F.min_by(F.struct(*others), F.struct(*first, *[F.col(c) for c in others if not dict(df.dtypes)[c].startswith("map")])).alias("r")).select(*together, key, "r.*")


def text_runs(items: DataFrame) -> DataFrame:
    """The fragments that hold text, with coordinates to one decimal; the text itself is not trimmed."""
    kept = items.where(F.col("str").isNotNull() & (trim("str") != ""))
    return kept.withColumns({c: F.round(c, 1) for c in ("x", "y", "w", "h")})


def watermarks(items: DataFrame, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """(session_id, page_index, text, n): the texts that are repeated on a page as a watermark is."""
    long = items.select(*PAGE, trim("str").alias("text")).where(F.length("text") >= LEAST_LENGTH)
    return long.groupBy(*PAGE, "text").agg(F.count("*").alias("n")).where(F.col("n") >= min_repeats)


def strip_watermarks(items: DataFrame, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """The fragments without those of a watermark.

    A window over page and text counts the repeats: fragments that are partitioned by page already are not moved again.
    """
    marked = items.withColumn("_text", trim("str")).withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE, "_text")))
    repeated = F.coalesce((F.length("_text") >= LEAST_LENGTH) & (F.col("_n") >= min_repeats), F.lit(False))
    return marked.where(~repeated).drop("_text", "_n")


def clean_recognised(text: Column) -> Column:
    """Recognised text without zero-width non-joiners; joiners, which conjuncts need, stay."""
    return F.replace(text, F.lit("\u200c"), F.lit(""))


def words_to_items(words: DataFrame, height: Column, scale: float = OCR_SCALE) -> DataFrame:
    """Recognised words (text, x0, y0, x1, y1 in pixels from the top left) as fragments in points from the bottom left."""
    placed = words.withColumns({"str": clean_recognised(F.col("text")), "x": F.col("x0") / scale, "y": (height - F.col("y1")) / scale, "w": (F.col("x1") - F.col("x0")) / scale, "h": (F.col("y1") - F.col("y0")) / scale, "font": F.lit("OCR")})
    return placed.where(trim("str") != "").drop("text", "x0", "y0", "x1", "y1")


def transliterate(items: DataFrame) -> DataFrame:
    """The fragments with `text`, in Unicode, and `unmapped`, the number of characters without a token."""
    coded = legacy.uses_table(F.col("str"), F.col("font"))
    return items.withColumns({"text": F.when(coded, legacy.convert(F.col("str"))).otherwise(F.col("str")), "unmapped": F.when(coded, legacy.unmapped(F.col("str"))).otherwise(F.lit(0).cast("bigint"))})


def font_tables(fonts: DataFrame) -> DataFrame:
    """(font, name, is_legacy) for each distinct font: its name without prefix, and whether the token table holds for it."""
    names = fonts.select("font").where("font IS NOT NULL").distinct()
    return names.select("font", legacy.strip_prefix(F.col("font")).alias("name"), legacy.uses_table(F.lit("a"), F.col("font")).alias("is_legacy"))


def coverage(items: DataFrame) -> DataFrame:
    """(font, characters, unmapped): how much of the legacy text of each font the token table knows."""
    coded = items.where(legacy.uses_table(F.col("str"), F.col("font")))
    return coded.groupBy(legacy.strip_prefix(F.col("font")).alias("font")).agg(F.sum(F.length("str")).cast("bigint").alias("characters"), F.sum(legacy.unmapped(F.col("str"))).cast("bigint").alias("unmapped"))

