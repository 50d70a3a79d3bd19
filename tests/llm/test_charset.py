"""Wrong decodings made by hand, restored, and texts that only look wrong."""

import pytest

from quirefold.llm import charset

RIGHT = ["fndõ", "fïlñ", "úyd", "lsï", "fNdaõ", "¿lï", "wñ", "fõ,d", "úñ", "mïï"]


def tables(spark, texts, font="FMAbhayax", fonts=()):
    """Tables of these fragments, of no questions and of these reference fonts."""
    items = spark.createDataFrame([(i, t, font) for i, t in enumerate(texts)], "item_id long, str string, font string")
    return items, spark.createDataFrame([], "question_id long, raw_legacy string"), spark.createDataFrame([(f,) for f in fonts], "font string")


def restored(spark, texts, *more):
    """What the fragments that are found come out as."""
    return {r["value"]: r["repaired"] for r in charset.repaired(*tables(spark, texts, *more)).where("field = 'str'").collect()}


@pytest.mark.parametrize("text", ["fmdïk ñõ", "café façade", "“old” — naïve", "ජිවැක පමණක් ද?"])
@pytest.mark.parametrize("times", [1, 2])
def test_utf8_read_as_a_code_page(text, times):
    wrong = text
    for _ in range(times):
        wrong = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in wrong.encode("utf-8"))
    assert charset.repair_sequences(wrong) == text


def test_only_the_span_is_decoded():
    assert charset.repair_sequences("අනුà·€ බව") == "අනුව බව"
    assert [x[2] for x in charset.spans("aÃ¤Ã¶bÃ©")] == ["äö", "é"]


def test_legacy_pairs_that_form_a_sequence_stay(spark):
    for text in ("pÑ¨x", "wÍ¿s", "fÍ±", "yä§¨l", "ï¨¿"):
        assert charset.repair_sequences(text) == text
    # Also where the pair itself was read as UTF-8 elsewhere, and so its character is known.
    assert restored(spark, ["È§ ls"] * 60 + ["ȧ ls"] * 2) == {"ȧ ls": "È§ ls"}


@pytest.mark.parametrize("page", [p for p in charset.WRONG if p != "latin-1"])
def test_code_page_read_as_another(spark, page):
    text = " ".join(RIGHT)
    wrong = text.encode("cp1252").decode(page)
    assert restored(spark, [text] * 60 + [wrong]) == {wrong: text}


def test_a_frequent_word_is_right_though_another_page_makes_common_characters_of_it(spark):
    # What Ô, § and Í stand for in other pages is far more frequent here; no word of the other reading occurs.
    assert restored(spark, [" ".join(RIGHT)] * 200 + ["YsÔr lÔ"] * 5 + ["v§ka"] * 4 + ["Ífra"] * 3) == {}


GLYPHS = "ÌÎÏÐÒÕÖ×ØÙÚÛÝÞâãåçèéðôöûý®·º»‡‰‹‘—¬£¦"


def test_glyphs_without_a_mapping_stay(spark):
    assert restored(spark, [" ".join(RIGHT)] * 50 + [f"ks{g}ud {g}" for g in GLYPHS for _ in range(4)]) == {}


def test_rare_foreign_words_and_signs_stay(spark):
    words = ["Malmö", "Tromsø", "Île", "Gdańsk", "±5", "5·3", "brand®", "α decay", "Ærø", "Čapek", "Łódź", "[Труд]"]
    usual = ["a café beside the “old” façade — naïve", "the pupil’s view, 18 °C, £40", "déjà-vu ¨ à"]
    assert restored(spark, usual * 100 + words * 3, None) == {}


def test_a_word_that_went_wrong_in_two_ways(spark):
    text = " ".join(RIGHT)
    mixed = "fndÃµ " + "fïlñ".encode("cp1252").decode("cp1250")
    assert restored(spark, [text] * 60 + [text.encode("cp1252").decode("cp1250"), mixed])[mixed] == "fndõ fïlñ"


def test_bracketed_foreign_words_stay(spark):
    assert restored(spark, [" ".join(RIGHT)] * 50 + ["lsï [Труд]@"]) == {}


NAMES = [("Größel-Grotesk", "cp1252"), ("Ласка-Текст", "cp1251"), ("Ласка-Текст", "koi8_r"), ("青嶺明朝", "shift_jis"), ("雲山楷体", "gbk")]


def test_font_names(spark):
    rows, want = [], {}
    for name, right in NAMES:
        for wrong in ("cp1252", "cp1251", "latin-1"):
            try:
                garbled = name.encode(right).decode(wrong)
            except UnicodeDecodeError:
                continue
            if garbled != name:
                want[f"ABCDEF+{garbled}"] = name
    # Correct names that no table lists, each once.
    unlisted = ["L’Étoile-Sérif", "São·Paulo", "McÉcole", "Ñandú™"]
    for i, name in enumerate([*want, *unlisted, *(n for n, _ in NAMES)]):
        rows.append((i, "x", name))
    items = spark.createDataFrame(rows, "item_id long, str string, font string")
    questions = spark.createDataFrame([], "question_id long, raw_legacy string")
    fonts = spark.createDataFrame([(n,) for n, _ in NAMES], "font string")
    assert {r["value"]: r["repaired"] for r in charset.repaired(items, questions, fonts).collect()} == want


def test_over_tables_with_nulls_repeats_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "cafÃ© x", "A+FMAbhayax", "z"), (1, "cafÃ© x", "A+FMAbhayax", "z"), (2, None, None, None), (3, "", "Se±al", "z"), (4, "lost �", None, "z"), (5, "é" * 50_000, "T", "z"), (None, "plain", "T", "z")], "item_id long, str string, font string, kind string")
    questions = spark.createDataFrame([(1, "naÃ¯ve", "t"), (2, None, None)], "question_id long, raw_legacy string, text string")
    fonts = spark.createDataFrame([("Señal",), (None,)], "font string")
    got = {tuple(r) for r in charset.found(items, questions, fonts).collect()}
    assert {("positioned_item", 1, "str"), ("positioned_item", 4, "str"), ("positioned_item", 3, "font"), ("question", 1, "raw_legacy")} <= got
    assert len(got) == 4
    assert charset.found(items.limit(0), questions.limit(0), fonts.limit(0)).count() == 0


def test_a_sequence_of_four_bytes_alone_is_a_case(spark):
    wrong = "😀".encode().decode("cp1252")
    items = spark.createDataFrame([(1, f"well done {wrong}", "T"), (2, "fmñ—“”", "T")], "item_id long, str string, font string")
    none = spark.createDataFrame([], "question_id long, raw_legacy string"), spark.createDataFrame([], "font string")
    assert [tuple(r) for r in charset.repaired(items, *none).collect()] == [("positioned_item", 1, "str", f"well done {wrong}", "well done 😀")]
