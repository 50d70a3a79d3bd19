"""Saved state as tables: last write wins, selections, edits, and writes after a quiet period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(saves: DataFrame, key: str = "session_id", version: str = "saved_at") -> DataFrame:
    """The last save of each key; of equal versions the greater source name. An aggregate, so one row leaves each task."""
    others = [c for c in saves.columns if c != key]
    tie = [F.col("source_name")] if "source_name" in others and version != "source_name" else []
    return saves.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(version), *tie)).alias("r")).select(key, "r.*")


def merged(saves: DataFrame, key: str = "session_id", version: str = "saved_at") -> DataFrame:
    """One row a key with the last value of each field that is not null: a partial save changes only the fields that it names."""
    others = [c for c in saves.columns if c not in (key, version)]
    tie = [F.col("source_name")] if "source_name" in others else []
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(version), *tie))).alias(c)
    return saves.where(F.col(key).isNotNull()).groupBy(key).agg(*(last(c) for c in others), F.max(version).alias(version))


def resolve(asked: DataFrame, saves: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, is_new) of each key asked for once: new is one that was never saved."""
    known = saves.select(key).distinct().withColumn("known", F.lit(True))
    return asked.where(F.col(key).isNotNull()).select(key).distinct().join(known, key, "left").select(key, F.col("known").isNull().alias("is_new"))


def initial(keys: DataFrame, created_at: Column, key: str = "session_id") -> DataFrame:
    """An empty session for each key: at the first step, with nothing chosen, no answers and no source."""
    fields = {"created_at": created_at, "source_name": F.lit(""), "source_kind": F.lit("pdf"), "question_pages": F.array().cast("array<int>"), "answer_page": F.lit(None).cast("int"), "has_no_answer_sheet": F.lit(False), "answer_key": F.create_map().cast("map<int,int>"), "step": F.lit(1)}
    return keys.select(key).distinct().select(key, *(v.alias(c) for c, v in fields.items()))


def at_step(saved: DataFrame, step: Column) -> DataFrame:
    """The sessions at another step, all else as it is."""
    return saved.withColumn("step", step.cast("int"))


def back(saved: DataFrame, step: int = 3) -> DataFrame:
    """The sessions at an earlier step with their results discarded, so that they are extracted again."""
    return at_step(saved, F.lit(step)).withColumn("answer_key", F.create_map().cast("map<int,int>"))


def stale(saves: DataFrame, chosen: Column, key: str = "session_id", version: str = "saved_at") -> DataFrame:
    """(key, stale): whether the last save of each key chooses otherwise than the one before, so that stored results do not hold.

    `chosen` names a selection (see selection_key). A key that was saved once has nothing stored, which is stale too.
    Only the two last saves of a key leave each task.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(version), F.desc("c"))
    two = saves.where(F.col(key).isNotNull()).select(key, version, F.coalesce(chosen, F.lit("")).alias("c")).withColumn("r", F.row_number().over(newest)).where("r <= 2")
    nth = lambda n: F.max(F.when(F.col("r") == n, F.col("c")))
    return two.groupBy(key).agg(F.coalesce(nth(1) != nth(2), F.lit(True)).alias("stale"))


def keep_only(saves: DataFrame, key_value: str, key: str = "session_id") -> DataFrame:
    """What is left when all other keys are deleted."""
    return saves.where(F.col(key) == key_value)


def selection_key(pages: Column, answer_page: Column, no_sheet: Column) -> Column:
    """The JSON text that names a selection; nulls stay in it."""
    return F.to_json(F.struct(pages.alias("questionPages"), answer_page.alias("answerPage"), no_sheet.alias("hasNoAnswerSheet")), {"ignoreNullFields": "false"})


def resume_pages(saved: DataFrame, suggested: DataFrame) -> DataFrame:
    """(session_id, page_index): the pages that each session chose before, or the suggested ones where it chose none.

    Pages stay rows: a bulk session may have more of them than one array should hold.
    """
    prior = saved.select("session_id", F.explode("question_pages").alias("page_index"))
    chose = saved.where(F.coalesce(F.size("question_pages"), F.lit(0)) > 0).select("session_id")
    others = saved.select("session_id").join(chose, "session_id", "left_anti")
    return prior.unionByName(suggested.select("session_id", "page_index").join(others, "session_id", "left_semi"))


def resume_answer(no_sheet: Column, prior: Column, suggested: Column) -> Column:
    """The answer page to show: none without a sheet, else the one chosen before, else the suggested one."""
    return F.when(F.coalesce(no_sheet, F.lit(False)), F.lit(None).cast("int")).otherwise(F.coalesce(prior, suggested))


def toggle_range(selected: Column, last: Column, clicked: Column) -> Column:
    """The pages selected after a click with shift: the whole range follows the clicked page; sorted, each once."""
    span = F.sequence(F.least(last, clicked), F.greatest(last, clicked))
    return F.array_sort(F.when(F.array_contains(selected, clicked), F.array_except(selected, span)).otherwise(F.array_union(selected, span)))


def apply_edits(questions: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """The questions with the values of their edits, and `edited` set.

    Edits have the key, any columns of the questions and, if wanted, `cleared`, an array of column names: a column named
    there becomes null, another takes the edit's value unless that is null.
    """
    fields = [c for c in edits.columns if c in questions.columns and c not in (key, "edited")]
    cleared = F.col("cleared") if "cleared" in edits.columns else F.array().cast("array<string>")
    e = edits.select(key, F.struct(*fields, F.coalesce(cleared, F.array().cast("array<string>")).alias("cleared")).alias("_edit_"))
    joined = questions.join(e, key, "left")
    value = lambda c: F.when(F.array_contains("_edit_.cleared", c), F.lit(None)).otherwise(F.coalesce(f"_edit_.{c}", c))
    return joined.withColumns({c: value(c) for c in fields} | {"edited": F.when(F.col("_edit_").isNotNull(), True).otherwise(F.col("edited"))}).drop("_edit_")


def debounced(events: DataFrame, key: str, ts: str, value: str, tie: str, quiet_seconds: float = 0.4) -> DataFrame:
    """(key, burst_end, value): the last value of each burst of events; a burst ends with a pause of at least the quiet period.

    A window looks at neighbours only, but sorts all events of a key in one task; see streaming.debounce for keys of any size.
    """
    order = Window.partitionBy(key).orderBy(ts, tie)
    pause = F.unix_micros(F.lead(ts).over(order).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("p", pause).where(F.col("p").isNull() | (F.col("p") >= quiet_seconds * 1e6)).select(key, F.col(ts).alias("burst_end"), F.col(value).alias("value"))


def set_answers(questions: DataFrame, key: DataFrame, unresolved: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, key (session_id, label, answer) and unresolved labels after the edits (session_id, number, answer).

    A null answer clears. All questions of an edit's number take its answer and count as edited; the label is no longer
    unresolved. Edits have one row for each session and number.
    """
    chosen = edits.select("session_id", "number", F.col("answer").cast("int").alias("_chosen_"), F.lit(True).alias("_hit_"))
    asked = questions.join(chosen, ["session_id", "number"], "left")
    asked = asked.withColumns({"correct_answer": F.when(F.col("_hit_"), F.col("_chosen_")).otherwise(F.col("correct_answer")), "edited": F.when(F.col("_hit_"), True).otherwise(F.col("edited"))}).drop("_chosen_", "_hit_")
    labels = edits.select("session_id", F.col("number").cast("bigint").alias("label"))
    kept = key.select("session_id", "label", "answer").join(labels, ["session_id", "label"], "left_anti")
    added = edits.where("answer IS NOT NULL").select("session_id", F.col("number").cast("bigint").alias("label"), F.col("answer").cast("bigint").alias("answer"))
    return asked, kept.unionByName(added), unresolved.join(labels, ["session_id", "label"], "left_anti")


class ResultCache:
    """Results by selection key: the same selection gives the same DataFrame, another one drops the last."""

    def __init__(self):
        self.key, self.result = None, None

    def get(self, key: str | None, run) -> DataFrame | None:
        if key is None:
            return None
        if key != self.key:
            if self.result is not None:
                self.result.unpersist()
            self.key, self.result = key, run().cache()
        return self.result
