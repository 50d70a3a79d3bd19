"""The whole extraction as one lazy plan: fragments to question rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators import answers, classify, cleanse, lines, pages, questions

#: More partitions than any table has.
MOST_PARTITIONS = (1 << 31) - 1


@dataclass
class Extraction:
    """The results of an extraction, each a DataFrame."""

    questions: DataFrame
    answer_key: DataFrame
    unresolved: DataFrame


def with_recognised(items: DataFrame, page_list: DataFrame, recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments with the pages that hold too few of them replaced by what a recogniser read, and the pages it read.

    A page that it failed on, or was not given, has no fragments; recognised has the columns of items.

    Fragments, what was read and the list of pages meet in one exchange by page, where a window counts. A union of tables that
    are partitioned alike would report their partitioning, which changes while a query adapts: joins above it then fail
    by unequal numbers of partitions. `coalesce` moves nothing and reports no partitioning.
    """
    kinds = dict(items.dtypes)
    listed = page_list.select(*cleanse.PAGE).distinct().select(*(c if c in cleanse.PAGE else F.lit(None).cast(kinds[c]).alias(c) for c in items.columns))
    parts = {"own": items, "read": recognised.select(*items.columns), "listed": listed}
    own, read, asked = (df.withColumn("_of", F.lit(of)) for of, df in parts.items())
    together = own.unionByName(read).unionByName(asked).coalesce(MOST_PARTITIONS)
    page = Window.partitionBy(*cleanse.PAGE)
    known = F.col("session_id").isNotNull() & F.col("page_index").isNotNull()
    few = known & (F.count_if(F.col("_of") == "listed").over(page) > 0) & (F.count_if(F.col("_of") == "own").over(page) < pages.OCR_LEAST_ITEMS)
    kept = together.withColumn("_few", few).where("_of = 'own' AND NOT _few OR _of = 'read' AND _few")
    return kept.select(*items.columns), kept.where("_of = 'read'").select(*cleanse.PAGE).distinct()


def extract(items: DataFrame, images: DataFrame, sessions: DataFrame, scanned_pages: DataFrame | None = None) -> Extraction:
    """Questions of the pages that each session selected, with kind, flags and answer.

    `sessions` has one row a session: question_pages (null: all pages), answer_page and has_no_answer_sheet. A session
    without an answer sheet has no key. Scanned pages are (session_id, page_index). `page_pos` is the place of a page in
    the selection (the page itself where all are), by which questions of one number stand in order: see `ordered`.

    Sessions meet the list of pages, not the fragments: a session may hold a third of them, a page holds few, and
    fragments stay partitioned by page.
    """
    page = list(cleanse.PAGE)
    chosen = sessions.select("session_id", "question_pages", "answer_page", F.coalesce("has_no_answer_sheet", F.lit(False)).alias("no_sheet"))
    listed = items.select(*page).distinct().join(chosen, "session_id")
    place = F.when(F.col("question_pages").isNull(), F.col("page_index").cast("bigint")).otherwise(F.nullif(F.array_position("question_pages", F.col("page_index")), F.lit(0).cast("bigint")))
    marked = listed.select(*page, (~F.col("no_sheet") & F.coalesce(F.col("page_index") == F.col("answer_page"), F.lit(False))).alias("is_sheet"), place.alias("page_pos"))
    mine = items.join(marked.where("is_sheet OR page_pos IS NOT NULL"), page)
    sheet = mine.where("is_sheet").select(*items.columns)
    page_items = mine.where("page_pos IS NOT NULL").select(*items.columns)
    labelled = answers.label_answers(answers.integers(sheet))
    key = answers.answer_key(labelled)
    raw = questions.parse(lines.group_into_lines(cleanse.strip_watermarks(page_items)))
    kinds = classify.classify(raw, images)
    if scanned_pages is not None:
        kinds = kinds.join(scanned_pages.distinct().withColumn("scanned", F.lit(True)), ["session_id", "page_index"], "left")
    else:
        kinds = kinds.withColumn("scanned", F.lit(False))
    by_label = key.select("session_id", F.col("label").cast("int").alias("number"), F.col("answer").cast("int").alias("correct_answer"))
    placed = kinds.join(marked.where("page_pos IS NOT NULL").select(*page, "page_pos"), page)
    rows = placed.join(by_label, ["session_id", "number"], "left").select(
        "session_id", "page_pos", F.format_string("p%d-q%d", "page_index", "number").alias("id"), "page_index", "q", "number", "stem", "options", "x", "y", "w", "h", "kind",
        classify.flags(F.col("unmapped"), F.coalesce("scanned", F.lit(False))).alias("flags"), "correct_answer", "raw_legacy", F.lit(False).alias("edited"),
    )
    return Extraction(rows, key, answers.unresolved(labelled))


def ordered(questions: DataFrame) -> DataFrame:
    """The questions in order: by session and number, then in the order of the selected pages, then as they stand on the page.

    A sort by ranges of all four, so that one large session is the work of many tasks.
    """
    return questions.orderBy("session_id", "number", "page_pos", "q")
