"""Token ids against a second library, exact round trips, and containers that hold every token once."""

import random
from pathlib import Path

import pytest

from quirefold.llm import packing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.RANK_FILE).exists(), reason="the rank file is not here")

TEXTS = ["", None, "plain words", "It's 1234 o'clock — naïve\n\n\n  x", "ජිවැක 👩‍👩‍👧 <|endoftext|>", " ", "\r\n\t ", "a" * 5_000, "word 12 " * 9_000, "ab1" * 20_000, "\x00\x7f"]


def test_same_ids_as_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(str(Path(tokens.RANK_FILE).with_suffix(".json")))
    other.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(df).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == (other.encode(text, add_special_tokens=False).ids if text else []), i


@pytest.mark.parametrize("cut", [10, 100, 1_000])
def test_cutting_changes_nothing(cut):
    rng = random.Random(cut)
    for _ in range(40):
        text = "".join(rng.choice("ab 1\n\té.'s🙂ක") for _ in range(3_000))
        assert tokens.encode(text, long_text=cut).tolist() == tokens.encode(text, long_text=10**9).tolist()
        assert "".join(tokens.pieces(text, cut)) == text


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    raw = tokens.decode_documents(tokens.encode_documents(df))
    assert {r["doc_id"]: bytes(r["raw"]) for r in raw.collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert tokens.encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_holds_every_token_once(seed):
    rng = random.Random(seed)
    sizes = [(i, rng.choice([1, 30, 500, 4_096, 4_097, 9_000, rng.randint(1, 4_096)])) for i in range(800)]
    rows = packing.pack(sizes)
    spans, used = {}, {}
    for container, key, a, b in rows:
        spans.setdefault(key, []).append((a, b))
        used[container] = used.get(container, 0) + b - a
    assert max(used.values()) <= packing.CAPACITY
    for key, n in sizes:
        cut = sorted(spans[key])
        assert cut[0][0] == 0 and cut[-1][1] == n and all(x[1] == y[0] for x, y in zip(cut, cut[1:]))
        assert n > packing.CAPACITY or len(cut) == 1
    assert sum(used.values()) / (len(used) * packing.CAPACITY) > 0.95


def test_packing_of_equal_sizes_and_costs():
    rows = packing.pack([(i, 3_000) for i in range(2_000)])
    assert len({r[0] for r in rows}) == 2_000
    even = packing.pack([(i, 1_000) for i in range(40)], capacity=4_000)
    loads = {}
    for c, _, a, b in even:
        loads[c] = loads.get(c, 0) + b - a
    assert set(loads.values()) == {4_000}


def test_documents_without_text_or_key(spark):
    df = spark.createDataFrame([(1, "some text", 7), (1, "some text", 7), (2, None, 7), (3, "", 7), (None, "x", 7), (4, "word " * 9_000, 7)], "doc_id long, text string, tokens int")
    rows = packing.pack_documents(df).collect()
    assert {r["doc_id"] for r in rows} == {1, 4}
    assert sum(r["tokens"] for r in rows if r["doc_id"] == 4) == len(tokens.encode("word " * 9_000))
    assert len([r for r in rows if r["doc_id"] == 1]) == 1
    assert packing.pack_documents(df.limit(0)).count() == 0
