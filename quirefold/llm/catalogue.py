"""The queries pN_ of the text operators and the SQL of those that SQL can express, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import charset, lookalike, neardup, oracles, packing, scannoise, subjects, tokens
from quirefold.session import spread, stash, table

def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.found(table(spark, sf_dir, "positioned_item"), table(spark, sf_dir, "question"), table(spark, sf_dir, "font_ref"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.repaired(table(spark, sf_dir, "positioned_item"), table(spark, sf_dir, "question"), table(spark, sf_dir, "font_ref"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannoise.Repair(table(spark, sf_dir, "text_line"), table(spark, sf_dir, "question")).found()


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannoise.Repair(table(spark, sf_dir, "text_line"), table(spark, sf_dir, "question")).texts()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(table(spark, sf_dir, "question")).toDF("question_a", "question_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "question"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(table(spark, sf_dir, "question"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent_values(table(spark, sf_dir, "question"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_containers(spark, sf_dir))


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cover(stash(p7_containers(spark, sf_dir), "containers"))


def _subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_ref")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(*_subjects(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.shares(*_subjects(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_texts, p4_found, p4_groups, p5_found, p5_forms, p6_ids, p7_containers, p7_fill, p7_cover, p8_found, p8_shares)}
ORACLES: dict[str, str] = oracles.ORACLES
