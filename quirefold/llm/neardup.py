"""Groups of records whose words, as multisets, have intersection / union of at least a threshold.

An element of a record is a word with its number of occurrence, so multisets become sets. Stages, each exact:

1. Records with the same elements form a class; one row of each class goes on, copies stay in the membership table.
2. Candidates: if two sets reach the threshold t, a set of size a shares at least ceil(t * a) elements with the other,
   so in any common order (rare elements first) their first a - ceil(t * a) + s elements share s. Elements are dealt by
   hash into s - 1 buckets, so one bucket holds two shared ones. Each class emits one key for each pair of its first
   elements in the same bucket, and an equi-join on the keys finds the candidates. Small sets use one bucket, larger ones
   four, which more than halves the keys; sets that may meet either kind emit both.
3. Pivot distance tables: a fingerprint is the parity of the elements in 256 bits, so two fingerprints differ in at most
   as many bits as the sets differ in elements. The Hamming distances to 18 reference fingerprints are computed once; they,
   and not the fingerprints, travel with the keys, packed in two words. By the triangle inequality a pair whose distances
   to any reference differ by more than (1 - t) / (1 + t) * (a + b) cannot reach the threshold and is discarded inside the join.
4. Survivors are verified, once each: on their fingerprints, and what is left on their elements.
5. Groups: classes that a chain of links connects are one group. Its edges are turned into stars around its smallest
   class by rounds of joins, each written once; the driver gets one truth value a round.

The order needs the document frequency of frequent elements only: those in more than 1 of `rare` records. There are at
most rare * (elements of a record) of them at any size of the input; the list goes to the tasks with the plan.

A key of two frequent elements may be in very many records. No more than the less frequent of its elements, which bounds it:
beyond HOT, the key's rows are dealt into a grid of cells of about HOT x HOT pairs, each a key of its own, so that a hot
key is the work of many tasks. No pair is dropped.

Defined results: null stems and options count as empty; a record without words is in no group; repeated rows of a key
count once; ties in the order fall to the element's hash. No cap holds on partners or candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import lookalike
from quirefold.session import spread, stash

THRESHOLD = 0.7
RARE = 2_000
#: Fixed value: the characters that are removed from both ends of a word.
EDGE = '.,?()“”‘’:!—"'
#: Reference fingerprints of WORDS x 64 bits. A distance is kept clipped to [PIVOT_LEAST, PIVOT_LEAST + 31], PER_WORD to a word,
#: each in FIELD bits: five for the distance, one for a sum with the slack, one that a subtraction may borrow.
WORDS, PIVOTS, PER_WORD, FIELD, PIVOT_LEAST, PIVOT_SPAN = 4, 18, 9, 7, 112, 31
#: How many rows of one key one task may hold on each side.
HOT = 20_000
#: Sets of at least LARGE elements use BUCKETS buckets.
LARGE, BUCKETS = 10, 4

#: The columns of a fingerprint.
PRINT = [f"f{i + 1}" for i in range(WORDS)]
_REFERENCES = np.random.default_rng(20).integers(0, 2**64, (PIVOTS, WORDS), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_sql() -> str:
    """SQL: (key, words) of the batch, words as hashes of the consistent form of stem and options."""
    shape = lambda c: f"CASE WHEN regexp_matches({c}, '{lookalike.SUSPECT}') THEN {lookalike.form_sql(c)} ELSE {c} END"
    text = "concat_ws(' ', stem, array_to_string(list_filter(options, lambda o: o IS NOT NULL), ' '))"
    edge = lookalike.quoted(EDGE)
    trimmed = f"list_transform(regexp_split_to_array(lower(form), '\\s+'), lambda w: trim(w, {edge}))"
    return f"SELECT key, list_transform(list_filter({trimmed}, lambda w: w <> ''), lambda w: hash(w)) AS words FROM (SELECT key, {shape('text')} AS form FROM (SELECT key, {text} AS text FROM batch))"


def _elements(docs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) sorted by both: each word of a document scrambled with its number of occurrence there."""
    order = np.lexsort((words, docs))
    docs, words = docs[order], words[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (words[1:] != words[:-1])
    starts = np.maximum.accumulate(np.where(fresh, np.arange(len(docs)), 0))
    elements = _mix(words + (np.arange(len(docs)) - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((elements, docs))
    return docs[order], elements[order]


def sketches(df: DataFrame, key: str, stem: str, options: str) -> DataFrame:
    """(key, n, k1, k2, p1, p2, f1..f4, elements): size, 128-bit name of the set, packed distances to the pivots, fingerprint, elements."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("key"), F.col(stem).alias("stem"), F.col(options).alias("options"))
    sql = _words_sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = lookalike.connection()
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            out = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("batch")
            rows = out.num_rows
            if not rows:
                continue
            lists = out.column("words").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            words = np.asarray(lists.flatten()).astype(np.uint64)
            docs, elements = _elements(np.repeat(np.arange(rows), sizes), words)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            at, full = ends[:-1], sizes > 0
            name = np.zeros((2, rows), np.uint64)
            parity = np.zeros((WORDS, rows), np.uint64)
            if full.any():
                starts = at[full]
                name[0, full] = np.add.reduceat(_mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                name[1, full] = np.bitwise_xor.reduceat(_mix(elements + np.uint64(0x1234567)), starts)
                bit, word = np.uint64(1) << (elements & np.uint64(63)), (elements >> np.uint64(6)) % np.uint64(WORDS)
                for i in range(WORDS):
                    parity[i, full] = np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), starts)
            packed = np.zeros((PIVOTS // PER_WORD, rows), np.uint64)
            for i, reference in enumerate(_REFERENCES):
                distance = np.clip(np.bitwise_count(parity ^ reference[:, None]).sum(0, dtype=np.int64) - PIVOT_LEAST, 0, PIVOT_SPAN)
                packed[i // PER_WORD] |= distance.astype(np.uint64) << np.uint64(FIELD * (i % PER_WORD))
            yield pa.RecordBatch.from_arrays(
                [out.column("key").combine_chunks().cast(batch.schema.field(0).type), pa.array(sizes.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (*name, *packed, *parity)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(elements.view(np.int64)))],
                ["key", "n", "k1", "k2", "p1", "p2", *PRINT, "elements"],
            )
        con.close()

    return narrow.mapInArrow(run, f"key {kind}, n int, k1 bigint, k2 bigint, p1 bigint, p2 bigint, {', '.join(f'{f} bigint' for f in PRINT)}, elements array<bigint>")


def _pairs_of(first: np.ndarray, common: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, bound) for each pair of elements of a row of `first` that fall into the same bucket; the bound is the lesser count."""
    keys, rows, bounds = [], [], []
    bucket = (first >> np.uint64(57)) % np.uint64(buckets)
    for i in range(first.shape[1] - 1):
        same = bucket[:, i : i + 1] == bucket[:, i + 1 :]
        low, high = np.minimum(first[:, i : i + 1], first[:, i + 1 :]), np.maximum(first[:, i : i + 1], first[:, i + 1 :])
        keys.append(_mix(low * np.uint64(3) + _mix(high) + np.uint64(buckets))[same])
        bounds.append(np.minimum(common[:, i : i + 1], common[:, i + 1 :])[same])
        rows.append(np.nonzero(same)[0])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(bounds)


def pair_keys(classes: DataFrame, frequent: dict[int, int], threshold: float, hot: int = HOT) -> DataFrame:
    """(pair_key, rep, n, p1, p2, parts): a row for each pair of first elements of a class that share a bucket; parts is the side of the key's grid."""
    kind = classes.schema["key"].dataType.simpleString()
    hashes = np.array(sorted(frequent), np.int64)
    counts = np.array([frequent[x] for x in hashes.tolist()], np.int64)
    # A set of up to this size can reach the threshold with one that is below LARGE.
    both = int((LARGE - 1) / threshold)
    shared_large = BUCKETS + 1 if LARGE * threshold > BUCKETS else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("elements")
            sizes = np.asarray(batch.column("n")).astype(np.int64)
            values = np.asarray(lists.flatten())
            common = np.zeros(len(values), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                common = np.where(hashes[at] == values, counts[at], 0)
            docs = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, common, docs))
            values, common = values[order].view(np.uint64), common[order]
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
            for buckets, shared, used in ((1, 2, (sizes > 1) & (sizes <= both)), (shared_large - 1, shared_large, sizes >= LARGE)):
                lengths = np.where(used, np.minimum(sizes, sizes - need + shared), 0)
                for length in np.unique(lengths[lengths > 1]).tolist():
                    rows = np.flatnonzero(lengths == length)
                    step = max(1, 400_000 // length**2)
                    for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                        spots = starts[some][:, None] + np.arange(length)
                        keys, owners, bounds = _pairs_of(values[spots], common[spots], buckets)
                        own = pa.array(some[owners])
                        parts = pa.array(np.maximum(1, -(-bounds // hot)).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(c).take(own) for c in ("key", "n", "p1", "p2")), parts], ["pair_key", "rep", "n", "p1", "p2", "parts"])

    return classes.select("key", "n", "p1", "p2", "elements").mapInArrow(run, f"pair_key bigint, rep {kind}, n int, p1 bigint, p2 bigint, parts int")


def _slack(threshold: float) -> Column:
    """In how many elements two sets may differ that reach the threshold."""
    return F.floor((F.col("n_a") + F.col("n_b")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9))


def _within(threshold: float) -> Column:
    """Whether the pair may reach the threshold: no pivot rules it out.

    All distances of a word are compared at once: slack + b - a borrows from a field's highest bit exactly where a - b is
    more than the slack, and so for b - a. A slack beyond the span of the distances rules nothing out.
    """
    ones = sum(1 << (FIELD * i) for i in range(PER_WORD))
    guards = F.lit(ones << (FIELD - 1))
    added = F.least(_slack(threshold), F.lit(PIVOT_SPAN)) * F.lit(ones)
    kept = lambda x, y: (F.col(y) + added).bitwiseOR(guards) - F.col(x)
    fine = [kept(f"p{w}_a", f"p{w}_b").bitwiseAND(kept(f"p{w}_b", f"p{w}_a")).bitwiseAND(guards) == guards for w in (1, 2)]
    return fine[0] & fine[1]


def _meeting(keyed: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b) of the rows that share a key and that neither their sizes nor a pivot rules out."""
    columns = ("pair_key", "rep", "n", "p1", "p2")
    near = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9) & (F.col("rep_a") < F.col("rep_b")) & _within(threshold)
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in columns))
    cool, hot = keyed.where("parts = 1"), keyed.where("parts > 1")
    met = side(cool, "a").join(side(cool, "b"), (F.col("pair_key_a") == F.col("pair_key_b")) & near)
    # A cell of the grid is a key of its own: one side is dealt to the rows, the other to the columns.
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))
    rows = hot.select("rep", "n", "p1", "p2", "pair_key", own.alias("own"), each.alias("each"))
    cells = [rows.withColumn("pair_key", F.xxhash64("pair_key", *order)) for order in (("own", "each"), ("each", "own"))]
    grid = side(cells[0], "a").join(side(cells[1], "b"), (F.col("pair_key_a") == F.col("pair_key_b")) & near)
    return met.select("rep_a", "rep_b").unionByName(grid.select("rep_a", "rep_b"))


def classes_and_links(df: DataFrame, key: str = "question_id", stem: str = "stem", options: str = "options", threshold: float = THRESHOLD, rare: int = RARE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Membership (key, rep, n) of every record, and links (rep_a, rep_b) between class representatives, rep_a < rep_b."""
    sketched = stash(sketches(spread(df.select(key, stem, options)), key, stem, options), "sketches")
    named = ["n", "k1", "k2"]
    reps = sketched.groupBy(*named).agg(F.min("key").alias("rep"))
    members = sketched.select("key", *named).distinct().join(reps, named).select("key", "rep", "n")
    total = sketched.count()
    counted = sketched.select(F.explode("elements").alias("e")).groupBy("e").count().where(F.col("count") > total / rare)
    frequent = {r["e"]: r["count"] for r in counted.collect()}
    classes = sketched.join(reps.where("n > 0").select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    # Written once: over two Python steps the optimiser makes the keys, and shuffles them, for each side of the join.
    keyed = stash(pair_keys(classes, frequent, threshold, hot), "keys")
    candidates = _meeting(keyed, threshold).distinct()
    prints = [sketched.select(F.col("key").alias(f"rep_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *PRINT))) for side in "ab"]
    apart = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in PRINT[1:]), F.bit_count(F.col(f"{PRINT[0]}_a").bitwiseXOR(F.col(f"{PRINT[0]}_b"))))
    close = candidates.join(prints[0], "rep_a").join(prints[1], "rep_b").where(apart <= _slack(threshold)).select("rep_a", "rep_b").distinct()
    # The columns of both sides are those that `classes` shuffles by key, so that one exchange serves all three.
    left, right = (sketched.select(F.col("key").alias(f"rep_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "p1", "p2", "elements"))) for side in "ab")
    shared = F.size(F.array_intersect("elements_a", "elements_b"))
    enough = shared >= (F.col("n_a") + F.col("n_b") - shared) * threshold - 1e-9
    return members, close.join(left, "rep_a").join(right, "rep_b").where(enough).select("rep_a", "rep_b").distinct()


def pairs(df: DataFrame, key: str = "question_id", stem: str = "stem", options: str = "options", threshold: float = THRESHOLD) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of records that reaches the threshold, copies included."""
    members, links = classes_and_links(df, key, stem, options, threshold)
    members = stash(members.where("n > 0"), "members")
    between = links.join(members.select(F.col("rep").alias("rep_a"), F.col("key").alias("x")), "rep_a").join(members.select(F.col("rep").alias("rep_b"), F.col("key").alias("y")), "rep_b")
    left, right = members.alias("l"), members.alias("r")
    copies = left.join(right, (F.col("l.rep") == F.col("r.rep")) & (F.col("l.key") < F.col("r.key"))).select(F.col("l.key").alias("x"), F.col("r.key").alias("y"))
    both = between.select("x", "y").unionByName(copies)
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one lower end, and no lower end is an upper one."""
    crossing = edges.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi").unionByName(edges.join(edges.select(F.col("lo").alias("hi")), "hi", "left_semi").select("hi"))
    return crossing.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(rep, head) of every linked class: the smallest class that a chain of links (rep_a, rep_b), rep_a < rep_b, leads to.

    Large stars hang the larger neighbours of a class onto its smallest one, small stars the class and its smaller ones;
    both keep what is connected, and their alternation ends in one star for each group, whatever its size or shape.
    """
    edges = stash(links.select(F.col("rep_b").alias("hi"), F.col("rep_a").alias("lo")).distinct(), "edges")
    while not _stars(edges):
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stash(large, "large-stars")
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lower, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        edges = stash(small.where("hi <> lo").distinct(), "edges")
    return edges.select(F.col("hi").alias("rep"), F.col("lo").alias("head")).unionByName(edges.select(F.col("lo").alias("rep"), F.col("lo").alias("head")).distinct())


def groups(df: DataFrame, key: str = "question_id", stem: str = "stem", options: str = "options", threshold: float = THRESHOLD) -> DataFrame:
    """(key, group_id, class_id, links) of each record.

    `group_id` is the smallest key of the records that chains of pairs at the threshold connect to it, null for a record
    without words; `class_id` the smallest key with the same words; `links` the number of linked classes.
    """
    members, links = classes_and_links(df, key, stem, options, threshold)
    links = stash(links, "links")
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    placed = members.join(ends.join(components(links), "rep"), "rep", "left")
    group = F.when(F.col("n") > 0, F.coalesce("head", "rep")).alias("group_id")
    return placed.select("key", group, F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")).withColumnRenamed("key", key)
