"""Lines of a page: fragments grouped by height within a tolerance, joined in reading order.

A line is open to a fragment that lies within the tolerance of the line's first fragment; fragments come from the top.
Only the last line can be open, and a step of more than the tolerance between neighbours always starts a line, so the
page is cut at those steps by a window and the sequential rule runs inside the pieces, which are about a line each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import WS
from quirefold.operators.cleanse import PAGE, transliterate

TOLERANCE = 3.0


def anchored(values: Column, tolerance: float) -> Column:
    """For a sorted array of numbers: the number of each one's group, whose first member lies within the tolerance.

    Values may rise or fall; groups count from 0.
    """
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        fresh = s["anchor"].isNull() | (F.abs(s["anchor"] - v) > tolerance)
        n = s["n"] + fresh.cast("int")
        return F.struct(F.when(fresh, v).otherwise(s["anchor"]).alias("anchor"), n.alias("n"), F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def join_texts(texts: Column) -> Column:
    """Texts joined by one blank each, none where one side has white space, and none after a bare opening number."""

    def step(s: Column, t: Column) -> Column:
        glued = (s["i"] == 1) & F.element_at(texts, 1).rlike(r"^[0-9]{1,2}\z")
        bare = (s["i"] == 0) | glued | s["last"].rlike(rf"{WS}\z") | t.rlike(f"^{WS}")
        # What the joined text ends with is its last piece that is not empty: only that is tested, however long the line is.
        last = F.when(t == "", s["last"]).otherwise(t)
        return F.struct((s["i"] + 1).alias("i"), last.alias("last"), F.concat(s["out"], F.when(bare, F.lit("")).otherwise(F.lit(" ")), t).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("last"), F.lit("").alias("out"))
    return F.aggregate(texts, start, step, lambda s: s["out"])


def line_numbers(items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(session_id, page_index, line_idx, members): the fragments of each line, from left to right, lines from the top."""
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y"), F.asc("item_idx"), F.asc("item_id"))
    stepped = items.where("y IS NOT NULL").withColumn("cut", (F.lag("y").over(down) - F.col("y") > tolerance).cast("int"))
    pieces = stepped.withColumn("piece", F.sum(F.coalesce("cut", F.lit(0))).over(down))
    member = F.struct((-F.col("y")).alias("fall"), "item_idx", "item_id", "x", "y", "w", "h", "str", "text", "unmapped")
    grouped = pieces.groupBy(*PAGE, "piece").agg(F.array_sort(F.collect_list(member)).alias("m"))
    numbered = grouped.withColumn("n", anchored(F.transform("m", lambda i: i["y"]), tolerance))
    each = numbered.select(*PAGE, "piece", F.explode(F.sequence(F.lit(0), F.array_max("n"))).alias("sub"), "m", "n")
    own = F.filter("m", lambda i, k: F.get("n", k) == F.col("sub"))
    right = F.array_sort(F.transform(own, lambda i: F.struct(i["x"].alias("x"), i["fall"].alias("fall"), i["item_idx"].alias("item_idx"), i["item_id"].alias("item_id"), i.alias("i"))))
    order = Window.partitionBy(*PAGE).orderBy("piece", "sub")
    return each.select(*PAGE, (F.row_number().over(order) - 1).alias("line_idx"), F.transform(right, lambda s: s["i"]).alias("members"))


def group_into_lines(items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(session_id, page_index, line_idx, text, raw, y, x, w, h, unmapped, items): the lines of each page.

    The box takes the highest top, the largest height and the whole width; null widths and heights count as 0.
    """
    lines = line_numbers(transliterate(items), tolerance)
    part = lambda f: F.transform("members", f)
    x, right = F.array_min(part(lambda i: i["x"])), F.array_max(part(lambda i: i["x"] + F.coalesce(i["w"], F.lit(0.0))))
    return lines.select(
        *PAGE, "line_idx", join_texts(part(lambda i: i["text"])).alias("text"), join_texts(part(lambda i: i["str"])).alias("raw"),
        F.array_max(part(lambda i: i["y"])).alias("y"), x.alias("x"), (right - x).alias("w"), F.array_max(part(lambda i: F.coalesce(i["h"], F.lit(0.0)))).alias("h"),
        F.aggregate(part(lambda i: i["unmapped"]), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("unmapped"), F.size("members").alias("items"),
    )
