"""Subjects on documents made of known vocabularies: held-out accuracy, stray words, nulls."""

import random

from quirefold.llm import subjects

TOPICS = {"law": "court verdict statute appeal plaintiff judge clause tribunal".split(), "music": "sonata chord violin octave melody soprano tempo choir".split(), "sport": "goal league striker referee medal sprint innings coach".split()}
PLAIN = "the table lists every row together with its column and some values are missing here after we drop part of them again".split()


def passage(rng, topic):
    return " ".join(rng.choice(TOPICS[topic]) if topic and i % 4 == 0 else rng.choice(PLAIN) for i in range(40))


def document(rng):
    found = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2]))
    parts = [passage(rng, t) for t in found for _ in range(rng.randint(1, 3))] + [passage(rng, None) for _ in range(rng.randint(1, 4))]
    stray = [t for t in TOPICS if t not in found]
    parts.append(f"unrelated ask about the {rng.choice(TOPICS[rng.choice(stray)])} later" if stray and rng.random() < 0.3 else "done")
    rng.shuffle(parts)
    return found, "\n\n".join(parts)


def tables(spark, seed=5, count=500):
    rng = random.Random(seed)
    docs = [(i, *document(rng)) for i in range(count)]
    labels = [(i, f" {t.upper()} " if i % 9 == 0 else t, "a") for i, found, _ in docs[: count // 2] for t in (found or ["none"])]
    documents = spark.createDataFrame([(i, t, "z") for i, _, t in docs] + [(90_001, None, "z"), (90_002, "", "z"), (90_003, " \n ", "z"), (0, docs[0][2], "z")], "doc_id long, text string, subject string")
    reference = spark.createDataFrame([(t, t.title(), " ".join(w[:2])) for t, w in TOPICS.items()], "subject string, title string, description string")
    return docs, documents, spark.createDataFrame(labels + [(None, "law", None), (3, None, None)], "doc_id long, subject string, text string"), reference


def test_held_out_documents(spark):
    docs, documents, labels, reference = tables(spark)
    got = {(r["doc_id"], r["subject"]) for r in subjects.found(documents, labels, reference).collect()}
    held = {(i, t) for i, found, _ in docs[len(docs) // 2 :] for t in found}
    hit = {g for g in got if g[0] >= len(docs) // 2}
    assert len(held & hit) / len(held) > 0.93
    assert len(held & hit) / len(hit) > 0.93
    assert not [g for g in got if g[0] > 90_000]


def test_empty_tables(spark):
    _, documents, labels, reference = tables(spark, count=40)
    assert subjects.found(documents, labels, reference.limit(0)).count() == 0
    assert subjects.found(documents.limit(0), labels.limit(0), reference).count() == 0


def test_long_text_and_windows():
    assert [tuple(x) for x in zip(*subjects.windows(50))] == [(0, 40), (20, 50)]
    assert [tuple(x) for x in zip(*subjects.windows(3))] == [(0, 3)]
    assert subjects.words("x = df['soil_n_77'] " + "A" * 5_000) == ["df", "soil_n"]


def test_words_keep_their_marks():
    assert subjects.words("ජිවැක පමණක් ශ්‍රී ලංකා, cafe\u0301 නම_දත්ත x1") == ["ජිවැක", "පමණක්", "ශ්‍රී", "ලංකා", "cafe\u0301", "නම_දත්ත"]
    paragraph = "අධිකරණය තීන්දුව ප්‍රකාශ කළේය " * 10
    assert sum(map(len, subjects.words(paragraph))) == len(paragraph.replace(" ", ""))
