"""Saved sessions, edits, order and export on rows made by hand: nulls, ties, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from quirefold import session
from quirefold.operators import export, sessions
from quirefold.plans import assemble

SAVE = "session_id string, saved_at int, source_name string, step int, answer_page int"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_partial_saves_change_only_what_they_name(spark):
    saves = spark.createDataFrame([("a", 1, "x.pdf", 1, 4), ("a", 2, None, 2, None), ("a", 3, None, None, None), ("b", 1, None, None, None), (None, 9, "z", 9, 9)], SAVE)
    merged = sessions.merged(saves).select("session_id", "source_name", "step", "answer_page", "saved_at")
    assert rows(merged) == {("a", "x.pdf", 2, 4, 3), ("b", None, None, None, 1)}
    assert sessions.merged(saves.limit(0)).count() == 0


def test_start_step_and_back(spark):
    saves = spark.createDataFrame([("a", 1, "x", 4, 4)], SAVE)
    asked = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), (None, 0)], "session_id string, is_new int")
    found = sessions.resolve(asked, saves)
    assert rows(found) == {("a", False), ("b", True)}
    fresh = sessions.initial(found.where("is_new"), F.timestamp_seconds(F.lit(0))).collect()
    assert len(fresh) == 1 and fresh[0]["step"] == 1 and fresh[0]["question_pages"] == [] and fresh[0]["answer_key"] == {} and fresh[0]["answer_page"] is None
    back = sessions.back(saves.withColumn("answer_key", F.create_map(F.lit(1), F.lit(2)))).collect()[0]
    assert back["step"] == 3 and back["answer_key"] == {} and back["answer_page"] == 4


def test_stored_results_hold_while_the_selection_stays(spark):
    saves = spark.createDataFrame([("a", 1, "p", 1, 1), ("a", 2, "p", 1, 1), ("b", 1, "p", 1, 1), ("b", 2, "q", 1, 1), ("c", 1, "p", 1, 1), ("d", 1, None, 1, 1), ("d", 2, None, 1, 1)], SAVE)
    assert rows(sessions.stale(saves, F.col("source_name"))) == {("a", False), ("b", True), ("c", True), ("d", False)}


def test_edits_of_every_field_and_clearing(spark):
    questions = spark.createDataFrame([(1, "s", ["a"], 2, False, "x"), (2, "t", None, 3, False, "x"), (3, None, ["c"], None, True, "x")], "id int, stem string, options array<string>, correct_answer int, edited boolean, edit string")
    edits = spark.createDataFrame([(1, None, ["b", "c"], 5, ["correct_answer"]), (3, "u", None, 4, None), (9, "v", None, None, None)], "id int, stem string, options array<string>, correct_answer int, cleared array<string>")
    got = {r["id"]: tuple(r) for r in sessions.apply_edits(questions, edits, "id").select("id", "stem", "options", "correct_answer", "edited").collect()}
    assert got == {1: (1, "s", ["b", "c"], None, True), 2: (2, "t", None, 3, False), 3: (3, "u", ["c"], 4, True)}


def test_answers_by_table(spark):
    asked = spark.createDataFrame([("s", 1, 2, False), ("s", 1, None, False), ("s", 2, 3, False)], "session_id string, number int, correct_answer int, edited boolean")
    key = spark.createDataFrame([("s", 1, 2), ("s", 2, 3)], "session_id string, label long, answer long")
    left = spark.createDataFrame([("s", 1), ("s", 7)], "session_id string, label long")
    edits = spark.createDataFrame([("s", 1, None)], "session_id string, number int, answer int")
    done, newkey, newleft = sessions.set_answers(asked, key, left, edits)
    assert sorted((r["number"], r["correct_answer"], r["edited"]) for r in done.collect() if r["number"] == 2) == [(2, 3, False)]
    assert all(r["correct_answer"] is None and r["edited"] for r in done.where("number = 1").collect())
    assert rows(newkey) == {("s", 2, 3)} and rows(newleft) == {("s", 7)}


def test_order_counts_gate_and_names(spark):
    found = spark.createDataFrame([("s", 2, 1, 1, "b"), ("s", 1, 2, 1, "a"), ("s", 1, 1, 1, "c"), ("r", 9, 1, 1, "a")], "session_id string, number int, page_pos long, q long, kind string")
    assert [(r["session_id"], r["number"], r["page_pos"]) for r in assemble.ordered(found).collect()] == [("r", 9, 1), ("s", 1, 1), ("s", 1, 2), ("s", 2, 1)]
    key = spark.createDataFrame([("s", 1, 2), ("s", 1, 3), ("s", 4, 1)], "session_id string, label long, answer long")
    assert rows(export.tab_counts(found, key)) == {("s", "a", 1), ("s", "b", 1), ("s", "c", 1), ("r", "a", 1), ("s", "answers", 2)}
    labelled = spark.createDataFrame([("s", 1, None), ("s", 2, 3), ("t", 1, 1)], "session_id string, label long, answer long")
    assert rows(export.gate(labelled)) == {("s", 1, False), ("t", 0, True)}
    names = spark.createDataFrame([("legacy", [0, 4]), (None, [])], "mode string, pages array<int>")
    assert rows(names.select(export.file_name(F.col("mode")), export.page_label(F.col("pages")))) == {("questions-legacy.xlsx", "1, 5"), ("questions.xlsx", "")}


def test_a_pause_of_exactly_the_quiet_period_ends_a_burst(spark):
    events = spark.sql("SELECT * FROM VALUES ('k', timestamp'2024-01-01 00:00:00', 1, 1), ('k', timestamp'2024-01-01 00:00:00.4', 2, 2), ('k', timestamp'2024-01-01 00:00:00.7', 3, 3) AS t(key, ts, value, n)")
    assert sorted(r["value"] for r in sessions.debounced(events, "key", "ts", "value", "n").collect()) == [1, 3]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_only_small_inputs_are_spread(spark, monkeypatch):
    small = spark.range(10).repartition(1)
    assert session.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SMALL", 1)
    assert session.spread(small).rdd.getNumPartitions() == 1
