"""Consistent forms of single texts, and what stays as it is."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import lookalike


def form(text):
    con = lookalike.connection()
    out = con.execute(f"SELECT {lookalike.form_sql('v')} FROM (SELECT ?::VARCHAR AS v)", [text]).fetchall()[0][0]
    con.close()
    return out


@pytest.mark.parametrize(
    "text, expected",
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ？", "full width?"), ("café", "café"), ("no break thin", "no break thin"), ("zero​width﻿", "zerowidth"), ("ironﬁeld", "ironfield"),
        ("stone‍head", "stonehead"), ("ක්‍රම", "ක්‍රම"), ("ක‍ර", "කර"), ("කො", "කො"), ("කം", "කം".replace("ം", "ං")),
        ("cоnfіrm", "confirm"), ("Βraelund", "Braelund"), ("[Мир] [Труд]", "[Мир] [Труд]"), ("[αβγ] Δt Ωm π", "[αβγ] Δt Ωm π"), ("", ""), ("line\nbreak", "line\nbreak"),
    ],
)
def test_forms(text, expected):
    assert form(text) == expected


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(alphabet=st.sampled_from(list("ab c.é̀１Ａකා්‍රං​а")), max_size=30))
def test_form_is_stable_and_composed(text):
    once = form(text)
    assert form(once) == once
    assert unicodedata.normalize("NFC", once) == once


def test_texts_that_are_not_suspect_are_their_form(spark):
    rows = [(1, "plain — café “x” £4", ["ජිවැක", None, ""]), (2, None, None), (3, "x" * 200_000 + "​", []), (3, "x" * 200_000 + "​", []), (None, "a b", ["ｂ"])]
    df = spark.createDataFrame([(*r, 0, "f") for r in rows], "question_id long, stem string, options array<string>, pos int, form string")
    got = sorted((r["question_id"] or 0, r["field"], r["pos"]) for r in lookalike.found(df).collect())
    assert got == [(0, "option", 1), (0, "stem", 0), (3, "stem", 0)]
    assert lookalike.consistent_values(df).where("question_id = 1").count() == 3
    assert lookalike.found(df.limit(0)).count() == 0
