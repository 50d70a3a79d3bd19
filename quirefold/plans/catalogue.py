"""The queries of the core and their equivalent SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import legacy
from quirefold.functions import text as T
from quirefold.operators import answers, audit, classify, cleanse, export, geometry, lines, packed, pages, questions, sessions
from quirefold.plans import assemble as plan
from quirefold.plans.oracles import ORACLES
from quirefold.session import spread, table
from quirefold.sources import files

#: A page height in points, for the queries over tables that have none.
PAGE_HEIGHT = 842.0


#: The columns of a fragment that reading order and text need.
PLACED = ("item_idx", "str", "x", "y", "w", "h", "font")
#: The columns of a saved session that name a selection.
SELECTION = ("question_pages", "answer_page", "has_no_answer_sheet")


# Deliveries are dropped by an aggregate over whole rows, so each query first names the columns that it reads.
def _items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    read = table(spark, sf_dir, "positioned_item").select("item_id", *cleanse.PAGE, *columns, "loaded_at")
    return cleanse.once(read, "item_id", cleanse.PAGE)


def _latest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return sessions.latest(table(spark, sf_dir, "exam_session").select("session_id", "source_name", "saved_at", *columns))


def _questions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return cleanse.once(table(spark, sf_dir, "question").select("question_id", *columns, "loaded_at"), "question_id")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.once(table(spark, sf_dir, "image_region"), "region_id")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cleanse.once(table(spark, sf_dir, "raw_question").select("rq_id", "session_id", "page_index", "stem", "options", "bbox", "loaded_at"), "rq_id")
    return raw.select("rq_id", "session_id", "page_index", "stem", "options", *(F.col(f"bbox.{c}").alias(c) for c in "xywh"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.once(table(spark, sf_dir, "text_line").where("source = 'ocr'"), "line_id")


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _latest(spark, sf_dir, "has_no_answer_sheet", "answer_page").where("NOT coalesce(has_no_answer_sheet, false)").select("session_id", F.col("answer_page").alias("page_index"))
    return _items(spark, sf_dir, "item_idx", "str", "x", "y").join(chosen, ["session_id", "page_index"], "left_semi")


def resolve_fonts(spark, sf_dir):
    """Font names stand for internal ids, families for the names; those that the table does not list keep their id."""
    names = table(spark, sf_dir, "font_ref").select(F.col("font").alias("font_id"), F.col("family").alias("name"))
    return files.resolve_fonts(_items(spark, sf_dir, "font"), names).select("item_id", "font")


def item_files(spark, sf_dir):
    """Each page written as one JSON array of fragments and read again."""
    read = files.parse_items(files.items_json(cleanse.once(table(spark, sf_dir, "positioned_item").select("item_id", *cleanse.PAGE, *PLACED, "loaded_at"), "item_id", cleanse.PAGE)), "value")
    return read.select("session_id", "page_index", "item_idx", "i.*")


def recognise_isolated(spark, sf_dir):
    """Scanned lines stand for page images and a reader of words fails on those that hold a digit: the others come through."""

    def reader(content: bytes) -> list[dict]:
        text = content.decode("utf-8")
        if any(c in "0123456789" for c in text):
            raise ValueError("unreadable")
        return [{"word": w} for w in text.split(" ")]

    images = _scanned(spark, sf_dir).select(F.col("line_id").alias("page_key"), F.encode("text", "utf-8").alias("content"))
    read = files.recognise_pages(images, reader, "word: string")
    return read.select(F.col("page_key").alias("line_id"), F.when(F.col("status") == "ok", F.lit("ok")).otherwise(F.lit("failed")).alias("status"), F.size("rows").alias("words"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.label_answers(answers.integers(_sheet(spark, sf_dir)))


def text_runs(spark, sf_dir):
    return cleanse.text_runs(_items(spark, sf_dir, *PLACED)).select("item_id", "str", "x", "y", "w", "h", "font")


def watermarks(spark, sf_dir):
    return cleanse.watermarks(_items(spark, sf_dir, "str"))


def watermark_strip(spark, sf_dir):
    return cleanse.strip_watermarks(_items(spark, sf_dir, "str")).select("item_id", "session_id", "page_index", "str")


def page_stats(spark, sf_dir):
    return pages.stats(_items(spark, sf_dir, "str"))


def page_needs_ocr(spark, sf_dir):
    return pages.needs_recognition(table(spark, sf_dir, "text_line"), _items(spark, sf_dir))


def suggest_question_pages(spark, sf_dir):
    return pages.question_pages(page_stats(spark, sf_dir))


def suggest_answer_page(spark, sf_dir):
    return pages.answer_page(page_stats(spark, sf_dir))


def ocr_clean(spark, sf_dir):
    return _scanned(spark, sf_dir).select("line_id", cleanse.clean_recognised(F.col("text")).alias("text"))


def ocr_to_points(spark, sf_dir):
    """The boxes stand for pixels from the top left, on a raster of 3,000 pixels at twice the size of the page."""
    at = lambda c: F.col(f"bbox.{c}")
    words = _scanned(spark, sf_dir).select("line_id", "text", at("x").alias("x0"), at("y").alias("y0"), (at("x") + at("w")).alias("x1"), (at("y") + at("h")).alias("y1"))
    return cleanse.words_to_items(words, F.lit(3000.0), 2.0).select("line_id", "str", "x", "y", "w", "h", "font")


def font_tables(spark, sf_dir):
    return cleanse.font_tables(table(spark, sf_dir, "positioned_item"))


def distinct_fonts(spark, sf_dir):
    return table(spark, sf_dir, "positioned_item").where("font IS NOT NULL").select(legacy.strip_prefix(F.col("font")).alias("font")).distinct()


def legacy_convert(spark, sf_dir):
    return cleanse.transliterate(_items(spark, sf_dir, "str", "font")).select("item_id", "text", "unmapped")


def coverage_ratio(spark, sf_dir):
    return cleanse.coverage(_items(spark, sf_dir, "str", "font"))


def _lines(spark, sf_dir):
    return lines.group_into_lines(_items(spark, sf_dir, *PLACED))


def line_groups(spark, sf_dir):
    return _lines(spark, sf_dir).select("session_id", "page_index", "line_idx", "y", "x", "w", "h", "unmapped", "items")


def line_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("session_id", "page_index", "line_idx", "text", "raw")


def question_openers(spark, sf_dir):
    read = cleanse.once(table(spark, sf_dir, "text_line"), "line_id").where(T.is_opener("text"))
    return read.select("line_id", T.opener_number("text").alias("number"), T.without_opener("text").alias("rest"))


def question_segments(spark, sf_dir):
    return questions.segments(_lines(spark, sf_dir)).select("session_id", "page_index", "line_idx", "q", "opens")


def question_parse(spark, sf_dir):
    return questions.parse(_lines(spark, sf_dir)).withColumn("options", F.array_join("options", "|"))


def legacy_split(spark, sf_dir):
    return questions.split_legacy(_questions(spark, sf_dir, "raw_legacy").where("raw_legacy IS NOT NULL"), "question_id").withColumn("options", F.array_join("options", "|"))


def classify_questions(spark, sf_dir):
    return classify.classify(_raw(spark, sf_dir), _images(spark, sf_dir)).select("rq_id", "kind")


def figure_overlap(spark, sf_dir):
    return classify.overlapping(_raw(spark, sf_dir), _images(spark, sf_dir), "rq_id")


def label_columns(spark, sf_dir):
    return answers.label_columns(answers.integers(_sheet(spark, sf_dir)))


def answer_pairs(spark, sf_dir):
    return _labelled(spark, sf_dir)


def answer_key(spark, sf_dir):
    return answers.answer_key(_labelled(spark, sf_dir))


def answer_unresolved(spark, sf_dir):
    return answers.unresolved(_labelled(spark, sf_dir))


def answer_unresolved_strict(spark, sf_dir):
    """The same with hardly any tolerance in height, so that jitter leaves labels without an answer."""
    return answers.unresolved(answers.label_answers(answers.integers(_sheet(spark, sf_dir)), row_tolerance=0.25))


def valid_answers(spark, sf_dir):
    """Question numbers stand for typed answers: 1 to 5, or nothing, may stand."""
    typed = _questions(spark, sf_dir, "number").select("question_id", F.when(F.col("number") != 7, F.col("number")).alias("typed"))
    return typed.where(answers.valid_answer("typed"))


def export_gate(spark, sf_dir):
    labelled = answers.label_answers(answers.integers(_sheet(spark, sf_dir)), row_tolerance=0.25)
    gated = export.gate(labelled)
    return gated.withColumn("file_name", export.file_name(F.when(F.col("may_export"), F.lit("legacy")).otherwise(F.lit("unicode"))))


def answer_grid(spark, sf_dir):
    return answers.grid_size(_labelled(spark, sf_dir))


def assemble(spark, sf_dir):
    found = plan.extract(_items(spark, sf_dir, *PLACED), _images(spark, sf_dir), _latest(spark, sf_dir, *SELECTION)).questions
    return found.withColumns({"options": F.array_join("options", "|"), "flags": F.array_join("flags", "|")})


def assemble_scanned(spark, sf_dir):
    """Questions of the scanned pages: their lines stand for what a recogniser read."""
    read = _scanned(spark, sf_dir)
    box = [F.col(f"bbox.{c}").alias(c) for c in ("x", "w", "h")]
    words = read.select("line_id", "session_id", "page_index", "line_idx", "text", "y", *box).select("session_id", "page_index", F.col("line_id").alias("item_id"), F.col("line_idx").alias("item_idx"), cleanse.clean_recognised(F.col("text")).alias("str"), "x", "y", "w", "h", F.lit("OCR").alias("font"))
    items, scanned = plan.with_recognised(_items(spark, sf_dir, *PLACED), read, words)
    found = plan.extract(items, _images(spark, sf_dir), _latest(spark, sf_dir, *SELECTION), scanned).questions.where(F.array_contains("flags", "ocr"))
    return found.select("session_id", "id", "page_index", "q", "number", "stem", F.array_join("options", "|").alias("options"), "kind", F.array_join("flags", "|").alias("flags"), "correct_answer")


def question_order(spark, sf_dir):
    found = plan.extract(_items(spark, sf_dir, *PLACED), _images(spark, sf_dir), _latest(spark, sf_dir, *SELECTION)).questions
    return plan.ordered(found.select("session_id", "number", "page_pos", "page_index", "q", "id"))


EXPORTED = ("number", "stem", "options", "kind", "correct_answer")


def export_unicode(spark, sf_dir):
    return export.rows(_questions(spark, sf_dir, *EXPORTED), "question_id")


def export_legacy(spark, sf_dir):
    return export.rows(_questions(spark, sf_dir, *EXPORTED, "raw_legacy"), "question_id", "legacy")


def kind_counts(spark, sf_dir):
    return export.kind_counts(_questions(spark, sf_dir, "kind"))


def kind_lists(spark, sf_dir):
    return export.ordered_by_kind(_questions(spark, sf_dir, "kind", "number"), "question_id")


def tab_counts(spark, sf_dir):
    return export.tab_counts(_questions(spark, sf_dir, "session_id", "kind"), answers.answer_key(_labelled(spark, sf_dir)))


def session_merged(spark, sf_dir):
    """Every second save of a session is made a partial one, without a step and a source."""
    saves = table(spark, sf_dir, "exam_session").select("session_id", "saved_at", "answer_page", *(F.when(F.second("saved_at") % 2 == 0, F.col(c)).alias(c) for c in ("source_name", "step")))
    return sessions.merged(saves).withColumn("saved_us", F.unix_micros("saved_at")).drop("saved_at")


def session_resolve(spark, sf_dir):
    """Each session of the fragments is asked for, and one that was never saved."""
    asked = table(spark, sf_dir, "positioned_item").select("session_id")
    return sessions.resolve(asked.unionByName(asked.select(F.concat("session_id", F.lit("-new")).alias("session_id"))), table(spark, sf_dir, "exam_session"))


def session_initial(spark, sf_dir):
    fresh = sessions.initial(session_resolve(spark, sf_dir).where("is_new"), F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    shown = {"created_us": F.unix_micros("created_at"), "pages": F.size("question_pages"), "answers": F.size("answer_key")}
    return fresh.withColumns(shown).drop("created_at", "question_pages", "answer_key")


def session_back(spark, sf_dir):
    moved = sessions.back(_latest(spark, sf_dir, "step", "answer_key", "answer_page"))
    return moved.select("session_id", "step", "answer_page", F.size("answer_key").alias("answers"))


def session_step(spark, sf_dir):
    return sessions.at_step(_latest(spark, sf_dir, "step"), F.least(F.col("step") + 1, F.lit(4))).select("session_id", "step")


def session_stale(spark, sf_dir):
    return sessions.stale(table(spark, sf_dir, "exam_session"), sessions.selection_key(*(F.col(c) for c in SELECTION)))


def session_latest(spark, sf_dir):
    return _latest(spark, sf_dir, "step", "answer_page").select("session_id", "source_name", "step", "answer_page", F.unix_micros("saved_at").alias("saved_us"))


def session_keep_one(spark, sf_dir):
    return sessions.keep_only(table(spark, sf_dir, "exam_session"), "s00000001").select("session_id", F.unix_micros("saved_at").alias("saved_us"), "step")


def selection_key(spark, sf_dir):
    return _latest(spark, sf_dir, *SELECTION).select("session_id", sessions.selection_key(F.col("question_pages"), F.col("answer_page"), F.col("has_no_answer_sheet")).alias("selection_key"))


def resume_pages(spark, sf_dir):
    return sessions.resume_pages(_latest(spark, sf_dir, "question_pages"), suggest_question_pages(spark, sf_dir))


def resume_answer(spark, sf_dir):
    sheet = suggest_answer_page(spark, sf_dir).select("session_id", F.col("page_index").alias("sheet"))
    joined = _latest(spark, sf_dir, *SELECTION).join(sheet, "session_id", "left")
    return joined.select("session_id", sessions.resume_answer(F.col("has_no_answer_sheet"), F.col("answer_page"), F.col("sheet")).alias("answer_page"))


def range_toggle(spark, sf_dir):
    chosen = _latest(spark, sf_dir, "question_pages").where("question_pages IS NOT NULL")
    return chosen.select("session_id", F.array_join(sessions.toggle_range(F.col("question_pages"), F.lit(1), F.lit(4)), ",").alias("pages"))


def apply_edits(spark, sf_dir):
    """Figure questions get another stem, kind and set of options, and some an answer; those on even pages lose theirs."""
    all_ = _questions(spark, sf_dir, "page_index", "stem", "options", "kind", "correct_answer", "edited")
    even = F.col("page_index") % 2 == 0
    edits = all_.where("kind = 'figure'").select(
        "question_id", F.concat("stem", F.lit(" *")).alias("stem"), F.lit("special").alias("kind"), F.reverse("options").alias("options"),
        F.when(~even & (F.col("page_index") % 3 == 0), F.lit(1)).alias("correct_answer"), F.when(even, F.array(F.lit("correct_answer"))).alias("cleared"),
    )
    done = sessions.apply_edits(all_, edits, "question_id")
    return done.select("question_id", "stem", F.array_join("options", "|").alias("options"), "kind", "correct_answer", "edited")


def _number_edits(spark, sf_dir):
    """Of each session: the answers of questions 3 and 8 are set, that of question 5 is cleared."""
    asked = _questions(spark, sf_dir, "session_id", "number").select("session_id", "number").distinct()
    return asked.where("number IN (3, 5, 8)").withColumn("answer", F.when(F.col("number") != 5, F.col("number") - 2))


def set_answers(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    asked = _questions(spark, sf_dir, "session_id", "number", "correct_answer", "edited")
    done, _, _ = sessions.set_answers(asked, answers.answer_key(labelled), answers.unresolved(labelled), _number_edits(spark, sf_dir))
    return done.select("question_id", "correct_answer", "edited")


def set_answers_key(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    _, key, _ = sessions.set_answers(_questions(spark, sf_dir, "session_id", "number", "correct_answer", "edited"), answers.answer_key(labelled), answers.unresolved(labelled), _number_edits(spark, sf_dir))
    return key


def debounced_keystrokes(spark, sf_dir):
    """Each event stands for four keystrokes, after 0, 0.3, 0.7 and 1.5 seconds: a pause of exactly 0.4 seconds ends a burst."""
    strokes = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.posexplode(F.array(*map(F.lit, (0, 300_000, 700_000, 1_500_000)))).alias("n", "after"))
    typed = strokes.select("user_id", F.timestamp_micros(F.col("us") + F.col("after")).alias("ts"), (F.col("event_id") * 4 + F.col("n")).alias("stroke"))
    return sessions.debounced(typed, "user_id", "ts", "stroke", "stroke").withColumn("burst_end", F.unix_micros("burst_end"))


def debounced_writes(spark, sf_dir):
    return sessions.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", quiet_seconds=86_400).withColumn("burst_end", F.unix_micros(F.col("burst_end").cast("timestamp")))


def url_audit(spark, sf_dir):
    # The texts name no hosts, so each gets two: one made of its source, and one of an asset server.
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" https://"), F.coalesce("source", F.lit("localhost")), F.lit(".net./a http://unpkg.com/"), F.col("doc_id").cast("string"))
    found = audit.hosts(spread(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))), "doc_id", "text")
    return audit.violations(found, spark.createDataFrame([("classroom.net",)], "host string"))


def affine_regions(spark, sf_dir):
    """Each box is drawn four times: in its place, turned inside a nested state, after that state ended, and after a restore that nothing saved."""
    none = F.lit(None).cast(geometry.MATRIX)
    op = lambda name, m=none: F.struct(F.lit(name).alias("op"), m.alias("m"))
    zero, one = F.lit(0.0), F.lit(1.0)
    move = geometry.matrix(one, zero, zero, one, F.col("x"), F.col("y"))
    size = geometry.matrix(F.col("w"), zero, zero, F.col("h"), zero, zero)
    turn = geometry.matrix(zero, one, -one, zero, zero, zero)
    ops = F.array(op("save"), op("transform", move), op("save"), op("transform", size), op("paint"), op("restore"), op("save"), op("transform", turn), op("transform", size), op("paint"), op("restore"), op("paint"), op("restore"), op("restore"), op("other"), op("transform", size), op("paint"), op("restore"))
    drawn = _images(spark, sf_dir).where("w IS NOT NULL").select("region_id", F.posexplode(geometry.image_boxes(ops)).alias("k", "b"))
    return drawn.select("region_id", "k", *(F.round(f"b.{c}", 6).alias(c) for c in "xywh"))


def screen_boxes(spark, sf_dir):
    return geometry.screen_box(_raw(spark, sf_dir), F.lit(PAGE_HEIGHT)).select("rq_id", "left", "top", "width", "height")


def failed_pages(spark, sf_dir):
    failed = _latest(spark, sf_dir, "ocr_failed_pages").where("size(ocr_failed_pages) > 0")
    return failed.select("session_id", export.page_label(F.col("ocr_failed_pages")).alias("label"))


def _packed(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    return {"question": (table(spark, sf_dir, "question"), "question_id"), "raw_question": (table(spark, sf_dir, "raw_question"), "rq_id")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.over_tables(packed.positions, _packed(spark, sf_dir))


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.over_tables(packed.unpack, _packed(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLES} | {f.__name__: f for f in (p3_found, p3_values)}
