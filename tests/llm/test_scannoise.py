"""Scanned pages made by hand from a small vocabulary, with known noise."""

import random

import numpy as np

from quirefold.llm import scannoise
from quirefold.llm.boosting import BoostedTrees, logistic

WORDS = [a + b for a in ("bridge", "market", "garden", "copper", "harbour", "temple", "canal", "forest") for b in ("keeper", "wright", "ledge", "watch", "store", "field", "ward", "guild")]
LINE = "line_id long, session_id string, page_index int, line_idx int, text string, y double, source string, tab string"
QUESTION = "question_id long, stem string, options array<string>, flags array<string>, word string"


def pages(spark, seed=1):
    rng = random.Random(seed)
    lines, key = [], 0
    for p in range(400):
        for i in range(6):
            lines.append((key, "clean", p, i, " ".join(rng.choice(WORDS) for _ in range(7)), 700.0 - 15 * i, "text", "x"))
            key += 1
    noise = {}
    for p in range(120):
        texts = [" ".join(rng.choice(WORDS) for _ in range(7)) for _ in range(8)]
        kinds = [set() for _ in texts]
        for i in range(7):
            if rng.random() < 0.3:
                word = rng.choice(WORDS)
                cut = rng.randint(3, len(word) - 3)
                texts[i], texts[i + 1] = f"{texts[i]} {word[:cut]}-", f"{word[cut:]} {texts[i + 1]}"
                kinds[i].add("hyphen")
        for i in range(1, 7):
            if rng.random() < 0.4:
                parts = texts[i].split(" ")
                parts[3] = parts[3].replace("e", "c", 1) if "e" in parts[3] else parts[3].replace("a", "o", 1)
                texts[i] = " ".join(parts)
                kinds[i].add("misread")
        page = [("Model Paper Series 2024 — Grade 9", 805.0, {"furniture"}), *((t, 770.0 - 15 * i, k) for i, (t, k) in enumerate(zip(texts, kinds))), (f"- {p} -", 45.0, {"furniture"})]
        for i, (text, y, kind) in enumerate(page):
            lines.append((key, "scan", p, i, text, y, "ocr", "x"))
            noise |= {("text_line", key, k): True for k in kind}
            key += 1
    stems = [(1, f"{WORDS[0]} {WORDS[1]} tem-\n- 7 -\nplewatch {WORDS[2]}", ["a"], ["ocr"], "w"), (2, f"{WORDS[3]} -\n{WORDS[4]}", None, ["ocr"], "w"), (3, None, None, None, None), (4, "", [], [], "w"), (None, "x", [], [], "w")]
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(stems, QUESTION), set(noise)


def test_found_and_texts(spark):
    lines, questions, noise = pages(spark)
    repair = scannoise.Repair(lines, questions)
    found = {tuple(r) for r in repair.found().collect()}
    assert {f for f in found if f[0] == "question"} == {("question", 1, "furniture"), ("question", 1, "hyphen")}
    mine = {f for f in found if f[0] == "text_line"}
    assert {f for f in mine if f[2] != "misread"} == {f for f in noise if f[2] != "misread"}
    wrong, hit = {f for f in noise if f[2] == "misread"}, {f for f in mine if f[2] == "misread"}
    assert len(wrong & hit) / len(wrong) > 0.9
    assert len(wrong & hit) / len(hit) > 0.9
    text = {(r["rec_table"], r["unit"]): r["text"] for r in repair.texts().collect()}
    assert text["question", "q1"] == f"{WORDS[0]} {WORDS[1]} templewatch {WORDS[2]}"
    assert text["question", "q4"] == "" and ("question", "q3") not in text


def test_capitals_and_paragraphs(spark):
    lines, questions, _ = pages(spark)
    page = [("Bridgcwatch marketward", 770.0), ("HARBOURWRIGHT, TEMPLCGUILD", 755.0), ("Canalfield copperstore", 725.0)]
    more = spark.createDataFrame([(10**7 + i, "scan", 999, i, t, y, "ocr", "x") for i, (t, y) in enumerate(page)], LINE)
    text = {r["unit"]: r["text"] for r in scannoise.Repair(lines.unionByName(more), questions).texts().collect()}
    assert text["scan/999"] == "Bridgewatch marketward HARBOURWRIGHT, TEMPLEGUILD\nCanalfield copperstore"


def test_all_probes_find_a_superset(spark):
    known = spark.createDataFrame([(w, 5) for w in WORDS], "word string, count long")
    unknown = spark.createDataFrame([(w.replace("e", "c", 1), True) for w in WORDS if "e" in w], "word string, scanned boolean")
    index = scannoise.inverted(known)
    some, every = ({(r["word"], r["candidate"]) for r in scannoise.candidates(unknown, index, probes).collect()} for probes in (5, None))
    assert some < every
    grams = lambda w: {f"^{w}$"[i : i + 3] for i in range(len(w))}
    asked = {r["word"] for r in unknown.collect()}
    assert every == {(a, b) for a in asked for b in WORDS if a != b and abs(len(a) - len(b)) <= 2 and grams(a) & grams(b)}


def test_split_trigrams_find_the_same(spark):
    known = spark.createDataFrame([(w, 5) for w in WORDS], "word string, count long")
    unknown = spark.createDataFrame([(w.replace("e", "c", 1), True) for w in WORDS if "e" in w], "word string, scanned boolean")
    index = scannoise.inverted(known)
    whole, split = (sorted((r["word"], r["candidate"]) for r in scannoise.candidates(unknown, index, 5, hot=hot).collect()) for hot in (100_000, 2))
    assert whole and whole == split


def test_planted_words_have_a_true_answer(spark):
    known = spark.createDataFrame([(w, 5) for w in WORDS], "word string, count long")
    ratios = spark.createDataFrame([("c", "e", 9, 2.0), ("rn", "m", 3, 1.0), ("x", "a", 5, -1.0)], "a string, b string, n long, ratio double")
    made = {(r["word"], r["truth"]) for r in scannoise.planted(known, ratios, 1_000).collect()}
    assert made and all(t in WORDS and w not in WORDS and "x" not in w for w, t in made)
    assert all(w.replace("rn", "m").replace("c", "e") == t.replace("c", "e") for w, t in made)


def test_empty_tables(spark):
    lines, questions, _ = pages(spark)
    assert scannoise.Repair(lines.limit(0), questions.limit(0)).found().count() == 0


def test_repeated_rows_and_nulls_change_nothing(spark):
    lines, questions, _ = pages(spark)
    some = lines.where("session_id = 'clean' OR page_index < 30")
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), (10**9, None, None, None, None, None, "ocr", None)], LINE)
    once = {tuple(r) for r in scannoise.Repair(some, questions).found().collect()}
    twice = {tuple(r) for r in scannoise.Repair(some.unionByName(some.where("session_id = 'scan'")).unionByName(nulls), questions).found().collect()}
    assert {x for x in once if x[2] != "misread"} == {x for x in twice if x[2] != "misread"}


def test_learners():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = BoostedTrees(rounds=60).fit(x[:1_500], y[:1_500]).predict(x[1_500:])
    assert ((p > 0.5) == y[1_500:]).mean() > 0.93
    w, b = logistic(x, (x[:, 2] > 0.3).astype(float))
    assert ((x @ w + b > 0) == (x[:, 2] > 0.3)).mean() > 0.97
    assert BoostedTrees().fit(np.empty((0, 4)), np.empty(0)).predict(x[:2]).shape == (2,)


def test_differences():
    assert scannoise.differences("garclen", "garden") == [("cl", "d")]
    assert scannoise.differences("abc", "abc") == [("", "")]


def test_differences_are_counted_over_all_words(spark, monkeypatch):
    lines, questions, _ = pages(spark)
    rare = [(10**6 + i, "clean", 900, i, w[:4] + "zq" + w[5:], 700.0, "text", "x") for i, w in enumerate(WORDS)]
    asked, candidates = [], scannoise.candidates
    monkeypatch.setattr(scannoise, "SAMPLE_WORDS", 10)
    monkeypatch.setattr(scannoise, "candidates", lambda unknown, known: asked.append(unknown) or candidates(unknown, known))
    scannoise.Repair(lines.unionByName(spark.createDataFrame(rare, LINE)), questions)
    assert {r[4] for r in rare} <= {r["word"] for r in asked[0].where("NOT scanned").collect()}


def test_no_difference_is_crowded_out(spark):
    letters = [chr(0x4E00 + i) for i in range(5_200)]
    scanned = [(f"stem{c}{k}x", True, f"stem{k}x", 2) for c in letters for k in "abc"]
    clean = [(f"mark{k}c", False, f"mark{k}d", 2) for k in "ab"]
    pairs = spark.createDataFrame(scanned + clean, "word string, scanned boolean, candidate string, count long")
    edited = scannoise.with_edits(pairs)
    ratios = {(r["a"], r["b"]): r["ratio"] for r in scannoise.edit_ratios(edited).collect()}
    assert all(ratios[c, ""] > 0 for c in letters)
    assert ratios["c", "d"] < 0
    rated = {r["word"]: r for r in scannoise.with_ratios(edited, scannoise.edit_ratios(edited)).where("NOT scanned").collect()}
    assert rated["markac"]["least"] == rated["markac"]["total"] == ratios["c", "d"]


def test_no_candidate_is_dropped_by_a_cap(spark):
    """A long word whose five rarest trigrams are all misread shares only common ones with its correction."""
    known = spark.createDataFrame([("harbourkeeper", 5), *((f"har{c}", 5) for c in "abcdefgh"), *((f"mkeep{c}", 5) for c in "abcdefgh"), *((w, 5) for w in ("arzq", "zqxvk", "vkke", "pxy"))], "word string, count long")
    unknown = spark.createDataFrame([("harzqxvkkeepxy", True)], "word string, scanned boolean")
    index = scannoise.inverted(known)
    found = {r["candidate"] for r in scannoise.candidates(unknown, index).collect()}
    assert "harbourkeeper" in found
    assert found == {r["candidate"] for r in scannoise.candidates(unknown, index, None).collect()}
    assert "harbourkeeper" not in {r["candidate"] for r in scannoise.candidates(unknown, index, 5).collect()}


def test_a_rare_class_is_told_apart():
    """Of 20,000 rows 60 are right, by a small value that quantiles of all rows do not reach."""
    rng = np.random.default_rng(2)
    x = rng.integers(3, 12, size=(20_000, 2)).astype(float)
    x[:60, 0], x[60:160, 0] = 1, 2
    y = (np.arange(20_000) < 60).astype(float)
    p = BoostedTrees().fit(x, y).predict(np.array([[1.0, 5.0], [2.0, 5.0], [7.0, 5.0]]))
    assert p[0] > 0.5 > p[1] and p[2] < 0.5


def test_pairs_compared_at_once_have_the_same_differences():
    rng = random.Random(3)
    word = lambda alphabet, most: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, most)))
    pairs = [(word(a, most), word(a, most)) for a in ("ab", "abcdefg", "aශ්‍1-'é\U0001f600", "a\0b") for most in (5, 12, 40, 90) for _ in range(150)]
    pairs += [(w, w.replace("e", "c", 1)) for w in WORDS] + [("abc", "abc"), ("garclen", "garden")]
    pair, x, y, a, b = scannoise.compared(*map(list, zip(*pairs)))
    found = [[] for _ in pairs]
    for k, *sizes, one, other in zip(pair.tolist(), x.tolist(), y.tolist(), a.to_pylist(), b.to_pylist()):
        found[k].append((*sizes, *((one, other) if max(sizes) <= 3 else ())))
    assert found == [[(len(s), len(t), *((s, t) if max(len(s), len(t)) <= 3 else ())) for s, t in scannoise.differences(w, o)] for w, o in pairs]


def test_shape_of_a_replacement(spark):
    pairs = [("garclen", "garden"), ("1l-é", "il"), ("coppeer", "copper"), ("abc", "xyzab"), ("xaaaayb", "zaaaawwwwb")]
    edited = scannoise.with_edits(spark.createDataFrame([(w, True, o, 5) for w, o in pairs], "word string, scanned boolean, candidate string, count long"))
    ratios = spark.createDataFrame([("cl", "d", 9, 2.0)], "a string, b string, n long, ratio double")
    rated = scannoise.with_ratios(edited, ratios).select(*scannoise.TOLD, "word").toArrow().to_batches()
    rows = {w: r for batch in rated for w, r in zip(batch.column("word").to_pylist(), scannoise.features(batch).tolist())}
    for word, other in pairs:
        sizes = [(len(s), len(t)) for s, t in scannoise.differences(word, other)]
        changed, ratio = sum(map(max, sizes)), 2.0 if word == "garclen" else 0.0
        foreign = 2 if word == "1l-é" else 0
        uneven, empty = max(abs(s - t) for s, t in sizes), float(any(not s or not t for s, t in sizes))
        assert rows[word] == [ratio, ratio, len(sizes), changed, changed / len(word), foreign, np.log(5), len(word), uneven, empty]


def test_a_line_is_taken_apart_once_and_not_for_each_of_its_words(spark):
    lines, _, _ = pages(spark)
    joins = np.array([2.0, 0.0, 0.0, 0.0]), -1.0
    plan = scannoise.tokens(scannoise.page_lines(lines).withColumn("furniture", scannoise.F.lit(False)), joins)._jdf.queryExecution().optimizedPlan().toString()
    above, generate, below = plan.partition("Generate posexplode")
    assert generate and "split(" in below
    assert "split(" not in above and "regexp_extract(" not in above


def test_equal_rows_weigh_as_many():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, size=(400, 3)).astype(float)
    y = (x[:, 0] + rng.random(400) > 2).astype(float)
    seen = []

    class Watched(BoostedTrees):
        def _split(self, binned, *rest):
            seen.append(len(binned))
            return super()._split(binned, *rest)

    p = Watched().fit(np.repeat(x, 5, axis=0), np.repeat(y, 5)).predict(x)
    assert max(seen) <= 2 * 4**3
    assert ((p > 0.5) == (y == 1)).mean() > 0.75
