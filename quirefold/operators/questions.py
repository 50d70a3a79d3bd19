"""Questions of a page: runs of lines from an opening number to a stop, and their stem and options.

A line that opens with a number starts a question. Lines follow it until a page number, or a gap of more than GAP_FACTOR
times the upper median of the question's gaps before; what lies between a stop and the next opening belongs to none. A
question without options is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.cleanse import PAGE

GAP_FACTOR = 2.5


def segments(lines: DataFrame, gap_factor: float = GAP_FACTOR) -> DataFrame:
    """The lines that belong to a question, with `q`, its place on the page, and `opens`."""
    page = Window.partitionBy(*PAGE).orderBy("line_idx")
    numbered = lines.withColumn("opens", T.is_opener("text")).withColumn("q", F.sum(F.col("opens").cast("int")).over(page)).where("q > 0")
    own = Window.partitionBy(*PAGE, "q").orderBy("line_idx")
    gapped = numbered.withColumn("gap", F.lag("y").over(own) - F.col("y"))
    before = gapped.withColumn("prior", F.sort_array(F.collect_list("gap").over(own.rowsBetween(Window.unboundedPreceding, -1))))
    median = F.try_element_at("prior", F.floor(F.size("prior") / 2).cast("int") + 1)
    stops = before.withColumn("stop", ~F.col("opens") & (T.is_page_number("text") | F.coalesce((F.size("prior") > 0) & (F.col("gap") > median * gap_factor), F.lit(False))))
    return stops.withColumn("stopped", F.sum(F.col("stop").cast("int")).over(own)).where("stopped = 0").drop("gap", "prior", "stop", "stopped")


def _pieces(line_text: Column, opens: Column) -> Column:
    """(starts, text) of a line's pieces: what comes before the markers, and each option."""
    parts = T.split_options(F.when(opens, T.without_opener(line_text)).otherwise(line_text))
    before = T.trim(F.element_at(parts, 1))
    # Text before a marker counts if there is any; a line without markers that opens nothing counts as it is.
    kept = (before != "") | (~opens & (F.size(parts) == 1))
    return F.concat(F.when(kept, F.array(F.struct(F.lit(False).alias("starts"), before.alias("text")))).otherwise(F.array().cast("array<struct<starts:boolean,text:string>>")), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda o: F.struct(F.lit(True).alias("starts"), o.alias("text"))))


def _assemble(pieces: Column) -> Column:
    """(stem, options) of a question's pieces in order: text without an option yet is stem, later text goes on an option."""
    start = F.struct(F.array().cast("array<string>").alias("stem"), F.array().cast("array<string>").alias("options"))

    def step(s: Column, p: Column) -> Column:
        first = ~p["starts"] & (F.size(s["options"]) == 0)
        longer = F.concat(F.slice(s["options"], 1, F.greatest(F.size(s["options"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(F.concat(F.array(F.lit("")), s["options"]), -1), F.lit(" "), p["text"])))
        return F.struct(
            F.when(first, F.concat(s["stem"], F.array(p["text"]))).otherwise(s["stem"]).alias("stem"),
            F.when(p["starts"], F.concat(s["options"], F.array(p["text"]))).when(first, s["options"]).otherwise(longer).alias("options"),
        )

    return F.aggregate(pieces, start, step)


def parse(lines: DataFrame, gap_factor: float = GAP_FACTOR) -> DataFrame:
    """(session_id, page_index, q, number, stem, options, x, y, w, h, raw_legacy, unmapped): the questions of each page."""
    kept = segments(lines, gap_factor).withColumn("pieces", _pieces(F.col("text"), F.col("opens")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_idx", F.col(c).alias("v")))), lambda s: s["v"])
    grouped = kept.groupBy(*PAGE, "q").agg(
        F.max(F.when(F.col("opens"), T.opener_number("text"))).alias("number"), F.flatten(ordered("pieces")).alias("pieces"), F.array_join(ordered("raw"), "").alias("raw_legacy"),
        F.min("x").alias("x"), F.max("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.min(F.col("y") - F.col("h")).alias("bottom"), F.sum("unmapped").cast("bigint").alias("unmapped"),
    )
    built = grouped.withColumn("built", _assemble(F.col("pieces"))).where(F.size("built.options") > 0)
    return built.select(*PAGE, "q", "number", T.squeeze(F.array_join("built.stem", " ")).alias("stem"), F.col("built.options").alias("options"), "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("y") - F.col("bottom")).alias("h"), "raw_legacy", "unmapped")


def split_legacy(df: DataFrame, key: str, raw: str = "raw_legacy") -> DataFrame:
    """(key, stem, options): raw source split at its opening number and its markers; null gives null."""
    parts = df.select(key, T.split_options(T.without_opener(F.col(raw))).alias("p"))
    return parts.select(key, T.trim(F.element_at("p", 1)).alias("stem"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("options"))
