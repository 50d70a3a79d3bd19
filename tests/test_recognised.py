"""Pages that are replaced by what a recogniser read, under plans that adapt."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quirefold.plans import assemble

SF_DIR = "/root/testdata/sf0.001"
ITEM = "session_id string, page_index int, item_id long, str string"


def fragments(spark, counts, text, first=0):
    rows = [(session, page, first + 1000 * k + i, text) for k, ((session, page), n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(rows, ITEM)


def test_pages_with_few_fragments_are_replaced(spark):
    own = {("s", 0): 12, ("s", 1): 9, ("s", 2): 10, ("s", 3): 3, ("t", 0): 2, (None, 0): 2, ("t", None): 1}
    read = {("s", 0): 1, ("s", 1): 2, ("s", 4): 3, ("u", 0): 1, (None, 0): 1, ("t", None): 1}
    # ("t", 0) and ("u", 0) are not on the list, ("s", 3) was not read: it has no fragments.
    listed = [("s", 0), ("s", 1), ("s", 1), ("s", 2), ("s", 3), ("s", 4), (None, 0), ("t", None)]
    page_list = spark.createDataFrame(listed, "session_id string, page_index int")
    items, scanned = assemble.with_recognised(fragments(spark, own, "own"), page_list, fragments(spark, read, "read", 10**6))
    got = {(r["session_id"], r["page_index"], r["str"]): r["count"] for r in items.groupBy("session_id", "page_index", "str").count().collect()}
    assert got == {("s", 0, "own"): 12, ("s", 1, "read"): 2, ("s", 2, "own"): 10, ("s", 4, "read"): 3, ("t", 0, "own"): 2, (None, 0, "own"): 2, ("t", None, "own"): 1}
    assert sorted(tuple(r) for r in scanned.collect()) == [("s", 1), ("s", 4)]


@pytest.fixture
def merging(spark):
    """Joins by sort and merge alone, as of tables that are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_over_replaced_pages(merging):
    """Inputs that are partitioned by page already, joined with their own pages."""
    counts = {("s", p): 12 - p for p in range(8)}
    by_page = lambda df: df.repartition("session_id", "page_index")
    own, read = by_page(fragments(merging, counts, "own")), by_page(fragments(merging, counts, "read", 10**6))
    items, scanned = assemble.with_recognised(own, own, read)
    sums = items.groupBy("session_id", "page_index").agg(F.count("*").alias("n"))
    joined = items.join(sums, ["session_id", "page_index"]).join(scanned.withColumn("scanned", F.lit(True)), ["session_id", "page_index"], "left")
    got = {(r["page_index"], r["str"], r["n"], r["scanned"]) for r in joined.collect()}
    assert got == {(p, "own" if p < 3 else "read", 12 - p, None if p < 3 else True) for p in range(8)}


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the test tables are not here")
def test_scanned_questions_by_merging(merging):
    found = __spark_entry__.queries()["assemble_scanned"]
    merged = sorted(map(repr, found(merging, SF_DIR).collect()))
    merging.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert merged and merged == sorted(map(repr, found(merging, SF_DIR).collect()))
