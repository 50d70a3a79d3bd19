"""Answer sheets: bare integers on a page, read by place. Labels stand in columns, and each one's answer to its right.

An integer of at least SEED can only be a label; their x coordinates give the label columns. An integer in a column is a
label, one from 1 to 5 elsewhere an answer. A label takes the nearest answer to its right within the band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import is_integer, trim
from quirefold.operators.cleanse import PAGE
from quirefold.operators.lines import anchored

COLUMN_TOLERANCE, ROW_TOLERANCE, REACH, SEED = 3.0, 4.0, 40.0, 6


def integers(items: DataFrame) -> DataFrame:
    """(session_id, page_index, item_idx, n, x, y): the fragments that are integers; too long ones have no number."""
    found = items.where(is_integer("str")).select(*PAGE, "item_idx", trim("str").try_cast("bigint").alias("n"), "x", "y")
    return found.where("n IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")


def _with_columns(numbers: DataFrame) -> DataFrame:
    """(session_id, page_index, m, anchors): a page's integers as one array, and the first x of each label column.

    A page is one sheet of paper, so its integers fit an array; pages without a label column are left out.
    """
    pages = numbers.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("item_idx", "n", "x", "y"))).alias("m"))
    xs = pages.withColumn("xs", F.array_sort(F.transform(F.filter("m", lambda i: i["n"] >= SEED), lambda i: i["x"])))
    grouped = xs.withColumn("c", anchored(F.col("xs"), COLUMN_TOLERANCE))
    first = F.filter("xs", lambda x, k: (k == 0) | (F.get("c", k) != F.get("c", k - 1)))
    return grouped.select(*PAGE, "m", first.alias("anchors"))


def label_columns(numbers: DataFrame) -> DataFrame:
    """(session_id, page_index, column_idx, x): the first x of each label column, from the left."""
    return _with_columns(numbers).select(*PAGE, F.posexplode_outer("anchors").alias("column_idx", "x")).where("column_idx IS NOT NULL")


def label_answers(numbers: DataFrame, row_tolerance: float = ROW_TOLERANCE, reach: float = REACH) -> DataFrame:
    """(session_id, page_index, item_idx, label, answer): every label, with its answer or null.

    Labels meet answers inside the page's array: one pass over the fragments, and no join.
    """
    in_column = lambda i: F.exists("anchors", lambda a: F.abs(a - i["x"]) <= COLUMN_TOLERANCE)
    split = _with_columns(numbers).select(*PAGE, F.filter("m", in_column).alias("labels"), F.filter("m", lambda i: ~in_column(i) & i["n"].between(1, 5)).alias("answers"))
    # The outer form: for the inner one the optimiser derives a filter on the whole expression and computes it once more.
    each = split.select(*PAGE, "answers", F.explode_outer("labels").alias("l")).where("l IS NOT NULL")
    dx = lambda a: a["x"] - F.col("l.x")
    near = F.filter("answers", lambda a: (F.abs(a["y"] - F.col("l.y")) <= row_tolerance) & (dx(a) > 0) & (dx(a) <= reach))
    best = F.array_min(F.transform(near, lambda a: F.struct(dx(a).alias("dx"), a["item_idx"].alias("item_idx"), a["n"].alias("n"))))
    return each.select(*PAGE, F.col("l.item_idx").alias("item_idx"), F.col("l.n").alias("label"), best["n"].alias("answer"))


def answer_key(labelled: DataFrame) -> DataFrame:
    """(session_id, page_index, label, answer): of a repeated label the last one that has an answer."""
    return labelled.where("answer IS NOT NULL").groupBy(*PAGE, "label").agg(F.max_by("answer", "item_idx").alias("answer"))


def unresolved(labelled: DataFrame) -> DataFrame:
    """(session_id, page_index, item_idx, label): the labels without an answer, repeated ones as often as they stand."""
    return labelled.where("answer IS NULL").select(*PAGE, "item_idx", "label")


def grid_size(keys: DataFrame, least: int = 40) -> DataFrame:
    """(session_id, cells): how many cells a grid of each session's answers needs; keys are (session_id, label)."""
    return keys.groupBy("session_id").agg(F.greatest(F.lit(least), F.max("label")).cast("bigint").alias("cells"))


def valid_answer(column: str):
    """Whether a typed answer may stand: null, which clears it, or 1 to 5."""
    return F.col(column).isNull() | F.col(column).between(1, 5)

