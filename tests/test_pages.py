"""Lines, questions, answers and pages on small pages written out by hand."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import legacy
from quirefold.functions import text as T
from quirefold.operators import answers, classify, cleanse, export, geometry, lines, pages, questions, sessions
from quirefold.sources import files

ITEM = "session_id string, page_index int, item_id long, item_idx int, str string, x double, y double, w double, h double, font string"


def items(spark, rows, font="TimesNewRomanPSMT"):
    return spark.createDataFrame([("s", 0, i, i, t, float(x), float(y), 10.0, 12.0, font) for i, (t, x, y) in enumerate(rows)], ITEM)


def test_line_anchor_does_not_move(spark):
    got = lines.group_into_lines(items(spark, [("a", 0, 100), ("b", 5, 98), ("c", 9, 96), ("d", 12, 94.5)])).orderBy("line_idx").collect()
    assert [r["text"] for r in got] == ["a b", "c d"]


def test_joining_rules(spark):
    got = lines.group_into_lines(items(spark, [("01", 0, 50), ("Stem", 9, 50), ("more ", 20, 50), ("end", 30, 50)])).first()
    assert got["text"] == "01Stem more end"
    assert (got["x"], got["w"], got["h"]) == (0.0, 40.0, 12.0)


@pytest.mark.parametrize("text, number, left", [("01. Stem", 1, "Stem"), ("7Stem", 7, "Stem"), ("11 grade", None, "11 grade"), ("123x", None, "123x"), ("5' x", 5, "x"), ("7\n", None, "7\n")])
def test_openers(spark, text, number, left):
    row = spark.createDataFrame([(text,)], "t string").select(T.is_opener("t").alias("o"), T.opener_number("t").alias("n"), T.without_opener("t").alias("r")).first()
    assert (row["n"], row["r"], row["o"]) == (number, left, number is not None)


def test_questions_stop_at_gaps_and_page_numbers(spark):
    page = [("header", 0, 800), ("01. Stem of", 0, 700), ("one? (1) a", 0, 685), ("(2) b", 0, 670), ("wrapped", 0, 655), ("far away", 0, 500), ("lost (1) x", 0, 485), ("02. Two (1) c (2)", 0, 470), ("d", 0, 455), ("12", 0, 440), ("03. No options", 0, 425)]
    got = questions.parse(lines.group_into_lines(items(spark, page))).orderBy("q").collect()
    assert [(r["number"], r["stem"], r["options"]) for r in got] == [(1, "Stem of one?", ["a", "b wrapped"]), (2, "Two", ["c", " d"])]


def test_answer_key(spark):
    page = [("10", 100, 500), ("3", 124, 501), ("1", 101, 480), ("5", 125, 478), ("7", 100, 460), ("2", 190, 460)]
    found = answers.label_answers(answers.integers(items(spark, page)))
    assert {r["label"]: r["answer"] for r in found.collect()} == {10: 3, 1: 5, 7: None}
    assert [r["x"] for r in answers.label_columns(answers.integers(items(spark, page))).collect()] == [100.0]


def test_only_small_numbers_give_no_labels(spark):
    assert answers.label_answers(answers.integers(items(spark, [("1", 100, 500), ("3", 124, 500)]))).count() == 0


def test_watermarks_and_page_suggestions(spark):
    rows = [("Sample paper text", 0, i) for i in range(4)] + [("short", 0, 9)] * 5 + [(m, 0, 20) for m in pages.MARKERS]
    df = items(spark, rows)
    assert cleanse.strip_watermarks(df).count() == 9
    assert pages.question_pages(pages.stats(df)).count() == 1
    sheet = items(spark, [(str(i), 0, i) for i in range(45)])
    assert pages.answer_page(pages.stats(sheet)).count() == 1


@pytest.mark.parametrize("text, expected", [("ld,h", "කාලය"), ("Y%aKsh", "ශ්‍ර්ණිය"), ("fY%aKsh", "ශ්‍රේණිය"), ("fld", "කො"), ("2025 - 01", "2025 - 01"), ("ld#", "කා⟨?⟩")])
def test_legacy_conversion(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(legacy.convert(F.col("t")).alias("u"), legacy.unmapped(F.col("t")).alias("n")).first()
    assert row["u"] == expected
    assert row["n"] == expected.count("⟨?⟩")


def test_kinds(spark):
    four = ["one", "two", "three", "four"]
    rows = [(1, "plain stem", four), (2, "x", four[:3]), (3, "x", ["A , B", *four[1:]]), (4, "which A one B two", four), (5, "මෙම රූපය බලන්න", four), (6, "x", None), (7, None, four)]
    df = spark.createDataFrame([(*r, "s", 0, 0.0, 10.0, 5.0, 5.0) for r in rows], "id int, stem string, options array<string>, session_id string, page_index int, x double, y double, w double, h double")
    images = spark.createDataFrame([("s", 1, 0.0, 10.0, 5.0, 5.0)], "session_id string, page_index int, x double, y double, w double, h double")
    got = {r["id"]: r["kind"] for r in classify.classify(df, images).collect()}
    assert got == {1: "straight", 2: "special", 3: "special", 4: "special", 5: "figure", 6: "special", 7: "straight"}
    touching = spark.createDataFrame([("s", 0, 5.0, 10.0, 5.0, 5.0)], images.schema)
    assert classify.overlapping(df, touching, "id").count() == 0


def test_export_and_state(spark):
    df = spark.createDataFrame([(1, 2, "stem", ["a", "b"], "straight", 2, "02. raw ^1&x ^2&y"), (2, 1, "s", ["a"], "figure", None, "")], "id int, number int, stem string, options array<string>, kind string, correct_answer int, raw_legacy string")
    row = export.rows(df, "id").first()
    assert (row["full_question"], row["correct_answer"]) == ("stem\n(1) a\n(2) b", "2. b")
    assert export.rows(df, "id", "legacy").first()["answers"] == "(1) x\n(2) y"
    toggled = spark.createDataFrame([([1, 5], 2, 4), ([2, 3, 9], 1, 3)], "s array<int>, a int, b int").select(sessions.toggle_range(F.col("s"), F.col("a"), F.col("b")).alias("t"))
    assert [r["t"] for r in toggled.collect()] == [[1, 2, 3, 4, 5], [9]]


def test_image_boxes_follow_the_matrix_stack(spark):
    m = lambda *v: dict(zip("abcdef", map(float, v)))
    ops = [{"op": "save", "m": None}, {"op": "transform", "m": m(2, 0, 0, 3, 10, 20)}, {"op": "paint", "m": None}, {"op": "restore", "m": None}, {"op": "restore", "m": None}, {"op": "transform", "m": m(0, 1, -1, 0, 5, 5)}, {"op": "paint", "m": None}]
    df = spark.createDataFrame([(ops,)], f"ops array<struct<op:string,m:{geometry.MATRIX}>>")
    boxes = df.select(geometry.image_boxes(F.col("ops")).alias("b")).first()["b"]
    assert [tuple(b) for b in boxes] == [(10.0, 20.0, 2.0, 3.0), (4.0, 5.0, 1.0, 1.0)]


def test_sources(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text('[{"str":"a","x":1,"y":2.5,"w":3,"h":4,"font":"F"},{"str":"b","x":1,"y":2,"w":3,"h":4,"font":null}]')
    assert [(r["item_idx"], r["str"]) for r in files.read_items(spark, str(path), "s", 0).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "boxes.json").write_text('{"0":[{"x":1,"y":2,"w":3,"h":4}],"4":[]}')
    assert files.read_regions(spark, str(tmp_path / "boxes.json"), "s").count() == 1
    pages_ = spark.createDataFrame([("p1", b"ok"), ("p2", b"bad")], "page_key string, content binary")

    def recogniser(content):
        if content == b"bad":
            raise ValueError("no text")
        return [{"text": "w", "x0": 1.0}]

    out = files.recognise_pages(pages_, recogniser, "text: string, x0: double")
    assert [r["page_key"] for r in files.failed_pages(out).collect()] == ["p2"]
    assert files.read_rows(out).count() == 1
    with pytest.raises(ValueError):
        files.accepted_upload(["image/png", "image/png"])


def test_empty_tables(spark):
    none = items(spark, [("x", 0, 0)]).limit(0)
    assert lines.group_into_lines(none).count() == 0
    assert questions.parse(lines.group_into_lines(none)).count() == 0
    assert answers.label_answers(answers.integers(none)).count() == 0


def test_workbook_and_written_items(spark, tmp_path):
    import zipfile

    from quirefold.sources import workbook

    df = spark.createDataFrame([(2, 7, "a & <b>", ["x"], "straight", 1, ""), (1, 3, "first", ["y", "z"], "straight", None, "")], "id int, number int, stem string, options array<string>, kind string, correct_answer int, raw_legacy string")
    path = str(tmp_path / "q.xlsx")
    assert workbook.write_workbook(export.rows(df, "id"), path) == 2
    with zipfile.ZipFile(path) as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.index("first") < sheet.index("a &amp; &lt;b&gt;") and 'width="70"' in sheet
    files.write_items(items(spark, [("a", 1, 2), ("b", 3, 2)]), str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "items")).count() == 2


def test_answers_that_are_set(spark):
    asked = spark.createDataFrame([("s", 1, None, False), ("s", 2, 3, False), ("t", 1, None, False)], "session_id string, number int, correct_answer int, edited boolean")
    key = spark.createDataFrame([("s", 2, 3)], "session_id string, label long, answer long")
    left = spark.createDataFrame([("s", 1)], "session_id string, label long")
    rows, newkey, newleft = sessions.set_answers(asked, key, left, spark.createDataFrame([("s", 1, 4)], "session_id string, number int, answer int"))
    assert {(r["session_id"], r["number"]): (r["correct_answer"], r["edited"]) for r in rows.collect()} == {("s", 1): (4, True), ("s", 2): (3, False), ("t", 1): (None, False)}
    assert {(r["label"], r["answer"]) for r in newkey.collect()} == {(2, 3), (1, 4)} and newleft.count() == 0
    cache = sessions.ResultCache()
    assert cache.get("a", lambda: asked) is cache.get("a", lambda: key) and cache.get(None, lambda: key) is None
