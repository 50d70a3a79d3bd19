"""Flat rows of questions for a spreadsheet, and counts by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.questions import split_legacy


def numbered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), F.coalesce(o, F.lit("")))), "\n")


def rows(questions: DataFrame, key: str, mode: str = "unicode") -> DataFrame:
    """(key, number, full_question, question, answers, correct_answer) of the straight questions; sort by number to write.

    Mode `legacy` takes stem and options from the raw source. Null options count as none; no answer gives an empty cell.
    """
    straight = questions.where("kind = 'straight'")
    if mode == "legacy":
        straight = straight.drop("stem", "options").join(split_legacy(straight, key), key)
    options = F.coalesce("options", F.array().cast("array<string>"))
    answer = F.when(F.coalesce(F.col("correct_answer"), F.lit(0)) > 0, F.concat(F.col("correct_answer").cast("string"), F.lit(". "), F.coalesce(F.get(options, F.col("correct_answer") - 1), F.lit("")))).otherwise(F.lit(""))
    stem = F.coalesce("stem", F.lit(""))
    return straight.select(key, "number", F.concat(stem, F.lit("\n"), numbered(options)).alias("full_question"), stem.alias("question"), numbered(options).alias("answers"), answer.alias("correct_answer"))


def write(exported: DataFrame, path: str, form: str = "parquet") -> None:
    """Write the rows in order of number with one of Spark's own formats; ranges keep the write parallel.

    Ranges take the key too, since there are few numbers and each may hold very many rows.
    """
    order = ["number", exported.columns[0]]
    exported.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").format(form).save(path)


def may_export(unresolved: DataFrame) -> bool:
    """Whether nothing is left unresolved."""
    return unresolved.isEmpty()


def kind_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("kind").agg(F.count("*").alias("questions"))


def ordered_by_kind(questions: DataFrame, *ties: str) -> DataFrame:
    """The questions in the order of three lists, one for each kind, each by number; a sort of ranges, not of one list in one task."""
    return questions.orderBy("kind", "number", *ties)


def tab_counts(questions: DataFrame, key: DataFrame) -> DataFrame:
    """(session_id, tab, n): of each session the questions of each kind, and as `answers` the labels of its key that have an answer."""
    kinds = questions.groupBy("session_id", F.col("kind").alias("tab")).agg(F.count("*").alias("n"))
    return kinds.unionByName(key.groupBy("session_id", F.lit("answers").alias("tab")).agg(F.count_distinct("label").alias("n")))


def file_name(mode: Column) -> Column:
    """The name of the exported file."""
    return F.when(mode == "legacy", F.lit("questions-legacy.xlsx")).otherwise(F.lit("questions.xlsx"))


def gate(labelled: DataFrame) -> DataFrame:
    """(session_id, unresolved, may_export) of each session with labels: an export waits until no label is unresolved."""
    counts = labelled.groupBy("session_id").agg(F.count_if(F.col("answer").isNull()).alias("unresolved"))
    return counts.withColumn("may_export", F.col("unresolved") == 0)


def page_label(pages: Column) -> Column:
    """Page indexes as people count them, in one text."""
    return F.array_join(F.transform(pages, lambda p: (p + 1).cast("string")), ", ")
