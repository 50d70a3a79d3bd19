"""Near-duplicate pairs against all pairs compared one by one."""

import random
from collections import Counter

import pytest

from quirefold.llm import neardup


def words(stem, options):
    text = [stem or "", *(o or "" for o in options or [])]
    return Counter(w for x in text for w in (p.strip(neardup.EDGE) for p in x.lower().split()) if w)


def brute(rows, threshold=0.7):
    seen = {k: words(s, o) for k, s, o in rows}
    keys, out = sorted(seen), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            union = sum((seen[a] | seen[b]).values())
            if union and sum((seen[a] & seen[b]).values()) >= threshold * union - 1e-9:
                out.add((a, b))
    return out


def made(rng, count, vocabulary, longest):
    rows = []
    for k in range(count):
        if rows and rng.random() < 0.6:
            _, stem, options = rng.choice(rows)
            parts, options = stem.split(), list(options)
            for _ in range(rng.randint(0, 3)):
                parts[rng.randrange(len(parts))] = f"w{rng.randrange(vocabulary)}"
            rng.shuffle(options)
            rows.append((k, " ".join(parts), options))
        else:
            rows.append((k, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, longest))), [f"w{rng.randrange(vocabulary)} x" for _ in range(rng.randint(0, 4))]))
    return rows


@pytest.mark.parametrize("vocabulary, longest", [(12, 6), (60, 14), (400, 40)])
def test_all_pairs(spark, vocabulary, longest):
    rows = made(random.Random(vocabulary), 220, vocabulary, longest)
    df = spark.createDataFrame(rows, "question_id long, stem string, options array<string>")
    got = {tuple(r) for r in neardup.pairs(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [2, 7])
def test_hot_keys_in_grids_lose_no_pair(spark, hot):
    rows = made(random.Random(5), 150, 12, 6)
    df = spark.createDataFrame(rows, "question_id long, stem string, options array<string>")
    members, links = neardup.classes_and_links(df, hot=hot)
    of = {r["key"]: r["rep"] for r in members.collect()}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(sorted((of[a], of[b]))) for a, b in brute(rows) if of[a] != of[b]}


def test_variants_of_one_template_that_share_its_rare_words(spark):
    # All meet on one key and no two reach the threshold: each cell of the grid is small, and pivots discard inside the join.
    rng = random.Random(3)
    rows = [(k, "zircon quartzite " + " ".join(f"w{rng.randrange(40)}" for _ in range(12)), None) for k in range(3_000)]
    df = spark.createDataFrame(rows, "question_id long, stem string, options array<string>")
    _, links = neardup.classes_and_links(df, hot=500)
    some = {k: words(s, None) for k, s, _ in rows}
    got = [(r["rep_a"], r["rep_b"]) for r in links.collect()]
    assert all(10 * sum((some[a] & some[b]).values()) >= 7 * sum((some[a] | some[b]).values()) for a, b in got)


def test_pivots_rule_out_no_pair_that_reaches_the_threshold():
    # The packed comparison against one distance at a time, at the edges of its fields.
    rng = random.Random(1)
    ones = sum(1 << (neardup.FIELD * i) for i in range(neardup.PER_WORD))
    guards = ones << (neardup.FIELD - 1)
    pack = lambda d: sum(x << (neardup.FIELD * i) for i, x in enumerate(d))
    for _ in range(5_000):
        a, b = ([rng.choice([0, 31, rng.randrange(32)]) for _ in range(neardup.PER_WORD)] for _ in "ab")
        slack = rng.randrange(32)
        kept = lambda x, y: ((y + slack * ones) | guards) - x
        assert ((kept(pack(a), pack(b)) & kept(pack(b), pack(a)) & guards) == guards) == all(abs(x - y) <= slack for x, y in zip(a, b))
        assert kept(pack(a), pack(b)) < 2**63


def test_frequent_elements_change_the_order_only(spark):
    rows = made(random.Random(9), 200, 80, 20)
    df = spark.createDataFrame(rows, "question_id long, stem string, options array<string>")
    members, links = neardup.classes_and_links(df, rare=20)
    rep = {r["key"]: r["rep"] for r in members.collect()}
    linked = {tuple(r) for r in links.collect()}
    assert {(a, b) for a, b in brute(rows) if rep[a] != rep[b]} == {(a, b) for a in rep for b in rep if a < b and tuple(sorted((rep[a], rep[b]))) in linked}


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [(1, None, None), (2, "", []), (3, "One two, three?", [None, "four"]), (4, "three one (two)", ["FOUR"]), (4, "three one (two)", ["FOUR"]), (5, "x", ["y"]), (6, "x x", None), (7, long, None), (8, long + " z", None), (None, "x", ["y"])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "question_id long, stem string, options array<string>, n int, elements string")
    assert {tuple(r) for r in neardup.pairs(df).collect()} == {(3, 4), (7, 8)}
    assert {r["question_id"]: r["class_id"] for r in neardup.groups(df).where("question_id IN (3, 4, 5)").collect()} == {3: 3, 4: 3, 5: 5}
    assert neardup.pairs(df.limit(0)).count() == 0


def test_groups_hold_all_that_chains_of_pairs_connect(spark):
    rows = made(random.Random(3), 220, 60, 14) + [(900 + i, " ".join(f"c{j}" for j in range(i, i + 12)), None) for i in (7, 0, 3, 11, 5, 1, 9, 2, 10, 4, 8, 6)] + [(990, None, None), (991, "", [])]
    head = {k: k for k, *_ in rows}
    for _ in rows:
        for a, b in brute(rows):
            head[a] = head[b] = min(head[a], head[b])
    df = spark.createDataFrame(rows, "question_id long, stem string, options array<string>")
    got = {r["question_id"]: r for r in neardup.groups(df).collect()}
    assert {k: r["group_id"] for k, r in got.items()} == head | {990: None, 991: None}
    assert {got[900 + i]["group_id"] for i in range(12)} == {900}
    assert got[905]["class_id"] == 905 and got[905]["links"] > 0


def test_a_small_edit_shares_the_group(spark):
    rows = [(1, "one two three four five six seven eight nine ten", None), (2, "one two three four five six seven eight nine eleven", None), (3, "quite another text", None)]
    df = spark.createDataFrame(rows, "question_id long, stem string, options array<string>")
    assert {r["question_id"]: r["group_id"] for r in neardup.groups(df).collect()} == {1: 1, 2: 1, 3: 3}
