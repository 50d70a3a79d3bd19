"""Packed strings against cases written out by hand and a brute-force packer."""

import random

import pytest

from quirefold.operators import packed


def values(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_legacy string")
    out = {}
    for r in packed.unpack(df, "id").collect():
        out.setdefault(r["id"], {})[r["pos"]] = r["value"]
    return [[v[k] for k in sorted(v)] if (v := out.get(i)) else [] for i in range(len(texts))]


CASES = [
    ("01.Stem?(1)a(2) b ( 3 )c", ["Stem?", "a", "b", "c"]),
    ("05' fuu ^1&da ^ 2 &db(3) dc", ["fuu", "da", "db", "dc"]),
    ("54Stem (1661) of(1)x(2)y", ["Stem (1661) of", "x", "y"]),
    ("a | b | c", ["a", "b", "c"]),
    ("a || b | c", ["a", "b", "c"]),
    ("a\tb\t|\tc\t|\t", ["a", "b", "c"]),
    ("a ; b;c ; d", ["a", "b;c", "d"]),
    ("a¦b¦¦c", ["a", "b", "", "c"]),
    ("a │ b • c", ["a", "b", "c"]),
    ("aÂ¦b â”‚ c", ["a", "b", "c"]),
    ('"a, b", c, "d ""e"" f"', ["a, b", "c", 'd "e" f']),
    ('["a", "b \\" c", ""]', ["a", 'b " c', ""]),
    ('"a";"";"c"', ["a", "", "c"]),
    ('stem, "o, p", q', ["stem", "o, p", "q"]),
    ('"x my;"; "y"', ["x my;", "y"]),
    ('The "odd" one ~ b', ['The "odd" one', "b"]),
    ('rd fld" ofc ~ b" c', ['rd fld" ofc', 'b" c']),
    ("only one value", []),
    ("", []), ("   ", []), (None, []),
]


def test_written_cases(spark):
    got = values(spark, [t for t, _ in CASES])
    for (text, expected), found in zip(CASES, got):
        assert found == expected, text


@pytest.mark.parametrize("kind", ["numbered", "quoted", "spaced"])
def test_round_trip(spark, kind):
    rng = random.Random(3)
    rows = [[" ".join(rng.choice(["alpha", "be-ta", "x,y", "ga;mma", "1990"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 6))] for _ in range(60)]
    if kind == "numbered":
        texts = [r[0] + "".join(f"({i}){v}" for i, v in enumerate(r[1:], 1)) for r in rows if len(r) < 7]
    elif kind == "quoted":
        texts = [", ".join(f'"{v}"' for v in r) for r in rows]
    else:
        texts = [" | ".join(r) for r in rows]
    for found, row in zip(values(spark, texts), rows):
        assert found[1:] == row[1:]
        assert len(found) == len(row)


def test_repeats_nulls_long_and_clashing_columns(spark):
    long = " | ".join(["word " * 200] * 300)
    df = spark.createDataFrame([(1, "a | b", "v", 1), (1, "a | b", "v", 2), (2, long, "v", 3), (None, "c | d", "v", 4), (3, None, None, None)], "id long, raw_legacy string, values string, k int")
    rows = packed.positions(df, "id").collect()
    assert len([r for r in rows if r["id"] == 1]) == 2
    assert len([r for r in rows if r["id"] == 2]) == 300
    assert packed.unpack(df, "id").where("id = 2").count() == 300
    assert packed.positions(df.limit(0), "id").count() == 0
    both = packed.over_tables(packed.positions, {"question": (df, "id"), "raw_question": (df, "id")})
    assert both.columns == ["rec_table", "rec_id", "pos"]
