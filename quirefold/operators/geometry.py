"""Affine matrices, the replay of drawing operations into image boxes, and boxes on screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
BOX = "struct<x:double,y:double,w:double,h:double>"
# Scale and paddings of a box on screen.
SCALE, ASCENT, PADDING, BOTTOM_PADDING = 1.4, 9.0, 6.0, 2.0


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*(x.cast("double").alias(n) for x, n in zip((a, b, c, d, e, f), "abcdef")))


def identity() -> Column:
    return matrix(*(F.lit(v) for v in (1, 0, 0, 1, 0, 0)))


def multiply(m: Column, n: Column) -> Column:
    """The matrix that applies n in the space of m."""
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"],
        m["b"] * n["c"] + m["d"] * n["d"], m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def apply_point(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def unit_box(m: Column) -> Column:
    """The box around the unit square's image under a matrix."""
    corners = [apply_point(m, F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    left, low = F.least(*xs), F.least(*ys)
    return F.struct(left.alias("x"), low.alias("y"), (F.greatest(*xs) - left).alias("w"), (F.greatest(*ys) - low).alias("h"))


def image_boxes(ops: Column) -> Column:
    """The boxes that an array of (op, m) paints: save, restore and transform keep a matrix stack; paint draws a unit square.

    A restore without a save gives the identity; other operations do nothing. The array is one page's.
    """
    start = F.struct(identity().alias("m"), F.array().cast(f"array<{MATRIX}>").alias("stack"), F.array().cast(f"array<{BOX}>").alias("boxes"))

    def step(s: Column, o: Column) -> Column:
        depth = F.size(s["stack"])
        top = F.coalesce(F.get(s["stack"], depth - 1), identity())
        m = F.when(o["op"] == "restore", top).when(o["op"] == "transform", multiply(s["m"], o["m"])).otherwise(s["m"])
        stack = F.when(o["op"] == "save", F.concat(s["stack"], F.array(s["m"]))).when((o["op"] == "restore") & (depth > 0), F.slice(s["stack"], 1, F.greatest(depth - 1, F.lit(0)))).otherwise(s["stack"])
        boxes = F.when(o["op"] == "paint", F.concat(s["boxes"], F.array(unit_box(s["m"])))).otherwise(s["boxes"])
        return F.struct(m.alias("m"), stack.alias("stack"), boxes.alias("boxes"))

    return F.aggregate(ops, start, step, lambda s: s["boxes"])


def screen_box(df: DataFrame, height: Column) -> DataFrame:
    """The rows with left, top, width and height on screen of their box x, y, w, h in points on a page of that height."""
    return df.withColumns({
        "left": F.col("x") * SCALE - PADDING, "top": (height - F.col("y") - ASCENT) * SCALE - PADDING,
        "width": F.col("w") * SCALE + 2 * PADDING, "height": (F.col("h") + ASCENT) * SCALE + PADDING + BOTTOM_PADDING,
    })
