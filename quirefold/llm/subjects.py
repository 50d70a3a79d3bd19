"""Subjects of documents: averaged word and subword embeddings with one independent logistic output for each subject.

A document is read as overlapping windows of WINDOW words; a window's vector is the average of its words' vectors, a
word's vector the average of its own embedding and those of its character n-grams (hashed into BUCKETS rows). Each
output of a document is the largest over its windows, so one whole passage is enough and a stray word, which fills a
small part of its window, is not.

The model is fitted on a bounded sample of at most SAMPLE_LABELS labelled documents and the subjects' own descriptions,
which are cut into words once and written as arrays in GRADIENT_TASKS partitions. In each step every partition computes
the gradient of its documents against the current parameters, the gradients are summed on the driver, and one Adam step
follows. What the driver gets in a step is GRADIENT_TASKS times the size of the model (1 MB), whatever the size of the
cluster or the data. Then every document is scored in one pass.

Defined results: null, empty and blank texts have no subject; labels are trimmed and lower-cased, unknown ones (such as
`none`) only say that the document has no other subject; repeated labels count once; ties do not matter, since outputs
are independent. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import spread, stash

WINDOW, STRIDE = 40, 20
BUCKETS, DIMENSIONS = 1 << 14, 16
SAMPLE_LABELS, GRADIENT_TASKS = 4_000, 4
STEPS, RATE, DECAY = 45, 0.08, 1e-4
#: After so many steps, labels that the model contradicts by more than DOUBT are left out.
WARM_STEPS, DOUBT = 18, 0.6
THRESHOLD = 0.35
#: How often a subject's own description counts, and the most words of which a task keeps the vectors.
DESCRIPTION_WEIGHT, KEPT_WORDS = 3.0, 400_000

#: Combining marks and joiners, which belong to a word but not to \w: without them words of Sinhala break at their vowel signs.
#: Those of four bytes stand apart: with them in it, a class is searched one range after the other.
_MARKS, _FAR_MARKS = ("".join(c for c in map(chr, range(*r)) if category(c)[0] == "M") for r in ((0x300, 0x10000), (0x10000, 0x20000)))
_MARK = re.compile(f"[{_MARKS}\u200c\u200d]")
_PART = rf"[^\W\d_]+(?:(?:[{_MARKS}\u200c\u200d]|[{_FAR_MARKS}])+[^\W\d_]*)*"
_MARKED_WORD = re.compile(rf"{_PART}(?:_{_PART})*")
#: The same for texts without marks, which it reads faster.
_WORD = re.compile(r"[^\W\d_]+(?:_[^\W\d_]+)*")
#: Packed binary data: runs of so many of its characters.
PACKED_RUN = 120
_PACKED = re.compile(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{PACKED_RUN},}}={{0,2}}")
#: A task scores so many words at once.
SCORED_WORDS = 200_000


def words(text: str) -> list[str]:
    """The words and identifiers of a text in lower case; numbers and packed binary data are none."""
    pattern = _MARKED_WORD if not text.isascii() and (_MARK.search(text) or max(text) > "\uffff") else _WORD
    # A run of packed data is part of a long piece between white space, which most texts have none of.
    if max(map(len, text.split()), default=0) >= PACKED_RUN:
        text = _PACKED.sub(" ", text)
    return [w for w in pattern.findall(text.lower().replace("\\n", "\n")) if 1 < len(w) <= 40]


def buckets(word: str) -> list[int]:
    """The rows of a word: one for itself, one for each of its parts and for each n-gram of 4 or 5 characters."""
    padded = f"<{word}>"
    grams = {padded[i : i + n] for n in (4, 5) for i in range(len(padded) - n + 1)} if len(word) > 3 else set()
    return sorted({zlib.crc32(x.encode()) % BUCKETS for x in [padded, *word.split("_"), *grams]})


def windows(count: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the windows over so many words; the last one ends with the text."""
    starts = np.arange(0, max(1, count - WINDOW + STRIDE), STRIDE)
    return starts, np.minimum(starts + WINDOW, count)


class Batch:
    """Documents as windows over a list of distinct words, with what the gradient needs, in flat arrays."""

    #: ids: the word at each place; starts, ends, docs: of each window; rows, sizes: the embedding rows of each word.
    ARRAYS = ("ids", "starts", "ends", "docs", "rows", "sizes")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.ids, self.starts, self.ends, self.docs, self.rows, self.sizes = (arrays[a] for a in self.ARRAYS)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    @classmethod
    def of(cls, texts: list[str]) -> "Batch":
        index: dict[str, int] = {}
        ids, starts, ends, docs, at = [], [], [], [], 0
        for d, text in enumerate(texts):
            found = [index.setdefault(w, len(index)) for w in words(text)]
            if found:
                a, b = windows(len(found))
                starts.append(a + at)
                ends.append(b + at)
                docs.append(np.full(len(a), d))
                ids += found
                at += len(found)
        rows = [buckets(w) for w in index]
        whole = lambda x: np.concatenate(x) if x else []
        found = (ids, whole(starts), whole(ends), whole(docs), [r for x in rows for r in x], [len(x) for x in rows])
        return cls({name: np.array(x, np.int32) for name, x in zip(cls.ARRAYS, found)})


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[starts]


def gradient(batch: Batch, y: np.ndarray, weight: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, doubt: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The summed gradient of the logistic losses of the documents, and the loss.

    A label that the model contradicts by more than `doubt` takes no part: labels are incomplete, and some are wrong.
    """
    ge, gw, gb = np.zeros_like(e), np.zeros_like(w), np.zeros_like(b)
    if not len(batch.ids):
        return ge, gw, gb, 0.0
    v = np.add.reduceat(e[batch.rows], batch.offsets) / batch.sizes[:, None]
    mean = _sums(v[batch.ids], batch.starts, batch.ends) / WINDOW
    out = mean @ w + b
    # For each document and output, the window of the largest value takes the gradient.
    order = np.flatnonzero(np.r_[True, batch.docs[1:] != batch.docs[:-1]])
    top = np.maximum.reduceat(out, order)
    doc = batch.docs[order]
    p = 1 / (1 + np.exp(-np.clip(top, -30, 30)))
    g = (p - y[doc]) * weight[doc][:, None] * (np.abs(p - y[doc]) <= doubt)
    loss = -float((weight[doc][:, None] * (y[doc] * np.log(p + 1e-9) + (1 - y[doc]) * np.log(1 - p + 1e-9))).sum())
    at = np.full((len(batch.docs), out.shape[1]), False)
    spot = np.repeat(np.arange(len(order)), np.diff(np.r_[order, len(batch.docs)]))
    at = out >= top[spot]
    go = np.where(at, g[spot], 0.0)
    gw += mean.T @ go
    gb += go.sum(0)
    gm = go @ w.T / WINDOW
    edge = np.zeros((len(batch.ids) + 1, e.shape[1]))
    np.add.at(edge, batch.starts, gm)
    np.add.at(edge, batch.ends, -gm)
    gv_token = np.cumsum(edge, axis=0)[:-1]
    order_w = np.argsort(batch.ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(batch.ids[order_w]) > 0])
    gv = np.add.reduceat(gv_token[order_w], first) / batch.sizes[:, None]
    spread_ = np.repeat(gv, batch.sizes, axis=0)
    for d in range(e.shape[1]):
        ge[:, d] += np.bincount(batch.rows, spread_[:, d], BUCKETS)
    return ge, gw, gb, loss


def prepared(rows: DataFrame, tasks: int = GRADIENT_TASKS) -> DataFrame:
    """(count, y, weight, arrays of a Batch as bytes): a row for each of `tasks` partitions of (text, y, weight)."""
    names = ["y", "weight", *Batch.ARRAYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            table = pa.Table.from_batches(tables)
            arrays = Batch.of(table.column("text").to_pylist()).arrays | {c: np.array(table.column(c).to_pylist(), np.float32) for c in ("y", "weight")}
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64()), *(pa.array([arrays[n].tobytes()], pa.binary()) for n in names)], ["count", *names])

    return rows.select("text", "y", "weight").repartition(tasks).mapInArrow(run, "count bigint, " + ", ".join(f"{n} binary" for n in names))


def _partial_gradient(row: dict, parameters: list[np.ndarray], doubt: float) -> bytes:
    batch = Batch({n: np.frombuffer(row[n], np.int32) for n in Batch.ARRAYS})
    y = np.frombuffer(row["y"], np.float32).reshape(row["count"], -1)
    ge, gw, gb, loss = gradient(batch, y, np.frombuffer(row["weight"], np.float32), *parameters, doubt)
    return np.concatenate([ge.ravel(), gw.ravel(), gb.ravel(), [loss]]).astype(np.float32).tobytes()


class Model:
    """Embeddings, output weights and intercepts."""

    def __init__(self, subjects: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.subjects = subjects
        self.e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
        self.w = rng.normal(0, 0.3, (DIMENSIONS, len(subjects)))
        self.b = np.full(len(subjects), -2.0)

    def fit(self, labelled: DataFrame, steps: int = STEPS) -> "Model":
        """Adam on the gradients that the partitions of `prepared` return; their number and their rows are bounded."""
        context = labelled.sparkSession.sparkContext
        shapes = [self.e.shape, self.w.shape, self.b.shape]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        theta = np.concatenate([x.ravel() for x in (self.e, self.w, self.b)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = max(1, labelled.agg(F.sum("count")).first()[0] or 0)
        for step in range(1, steps + 1):
            sent = context.broadcast([x.reshape(s).astype(np.float32) for x, s in zip(np.split(theta, cuts[:-1]), shapes)])

            def part(batches: Iterator[pa.RecordBatch], sent=sent, doubt=DOUBT if step > WARM_STEPS else 1.0) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([_partial_gradient(r, sent.value, doubt) for r in batch.to_pylist()], pa.binary())], ["g"])

            g = np.zeros(len(theta) + 1)
            for row in labelled.mapInArrow(part, "g binary").collect():
                g += np.frombuffer(row["g"], np.float32)
            sent.destroy()
            g = g[:-1] / total + DECAY * theta * np.r_[np.ones(cuts[1]), np.zeros(len(theta) - cuts[1])] / total
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1.0, 2.0 * (1 - step / (steps + 1)) + 0.1)
        self.e, self.w, self.b = (x.reshape(s).astype(np.float32) for x, s in zip(np.split(theta, cuts[:-1]), shapes))
        return self

    def outputs(self, texts: list[str | None], words_: "Shares") -> np.ndarray:
        """The probability of each subject for each text."""
        out = np.zeros((len(texts), len(self.subjects)))
        ids, starts, ends, docs, firsts = [], [], [], [], []

        def score() -> None:
            if docs:
                shares = words_.of(ids)
                sums = _sums(shares, np.concatenate(starts), np.concatenate(ends)) / WINDOW + self.b
                out[docs] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(sums, firsts), -30, 30)))
                for x in (ids, starts, ends, docs, firsts):
                    x.clear()

        count = 0
        for d, text in enumerate(texts):
            found = words(text) if text else []
            if found:
                a, b = windows(len(found))
                starts.append(a + len(ids))
                ends.append(b + len(ids))
                firsts.append(count)
                docs.append(d)
                ids += words_.number(found)
                count += len(a)
            if len(ids) >= SCORED_WORDS:
                score()
                count = 0
        score()
        return out


class Shares:
    """What each word that a task has met adds to the outputs; begun again when they are more than KEPT_WORDS."""

    def __init__(self, model: Model):
        self.rows = model.e.astype(np.float64) @ model.w
        self.known: dict[str, int] = {}
        self.table = np.zeros((4_096, self.rows.shape[1]))
        self.done = 0

    def number(self, found: list[str]) -> list[int]:
        known = self.known
        return [known.setdefault(w, len(known)) for w in found]

    def of(self, ids: list[int]) -> np.ndarray:
        """The shares of the numbered words, in the order of their numbers' list."""
        fresh = list(islice(reversed(self.known), len(self.known) - self.done))[::-1]
        if fresh:
            rows = [buckets(w) for w in fresh]
            sizes = np.array([len(r) for r in rows])
            added = np.add.reduceat(self.rows[np.fromiter(chain.from_iterable(rows), np.int64, sizes.sum())], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]
            if len(self.known) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(len(self.table), len(fresh)), self.table.shape[1]))])
            self.table[self.done : len(self.known)] = added
            self.done = len(self.known)
        shares = self.table[ids]
        if self.done > KEPT_WORDS:
            self.known.clear()
            self.done = 0
        return shares


def training_rows(documents: DataFrame, labels: DataFrame, reference: DataFrame, subjects: list[str], sample_labels: int = SAMPLE_LABELS) -> DataFrame:
    """(text, y, weight): labelled documents, at most so many, and the subjects' titles and descriptions."""
    tagged = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("subject"))).alias("found"))
    tagged = tagged.orderBy(F.xxhash64("doc_id")).limit(sample_labels)
    y = F.array(*(F.array_contains("found", s).cast("double") for s in subjects))
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(tagged), "doc_id").dropDuplicates(["doc_id"])
    rows = texts.select("text", y.alias("y"), F.lit(1.0).alias("weight"))
    own = reference.select(F.concat_ws(". ", "title", *["description"] * 4).alias("text"), F.array(*((F.col("subject") == s).cast("double") for s in subjects)).alias("y"), F.lit(DESCRIPTION_WEIGHT).alias("weight"))
    return rows.unionByName(own)


def classify(documents: DataFrame, labels: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, sample_labels: int = SAMPLE_LABELS) -> DataFrame:
    """(doc_id, subject, score): the subjects of every document whose output passes the threshold."""
    subjects = sorted(r["subject"] for r in reference.select("subject").distinct().collect() if r["subject"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not subjects:
        return documents.sparkSession.createDataFrame([], f"doc_id {kind}, subject string, score double")
    model = Model(subjects).fit(stash(prepared(training_rows(documents, labels, reference, subjects, sample_labels)), "labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = Shares(model)
        for batch in batches:
            p = model.outputs(batch.column(1).to_pylist(), shares)
            d, s = np.nonzero(p > threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([subjects[i] for i in s], pa.string()), pa.array(p[d, s], pa.float64())], ["doc_id", "subject", "score"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, subject string, score double")


def found(documents: DataFrame, labels: DataFrame, reference: DataFrame) -> DataFrame:
    """(doc_id, subject), once each."""
    return classify(documents, labels, reference).select("doc_id", "subject").distinct()


def shares(documents: DataFrame, labels: DataFrame, reference: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents are about each subject of the reference, and their share of all documents."""
    total = documents.select("doc_id").distinct().agg(F.count("*").alias("total")).scalar()
    counted = found(documents, labels, reference).groupBy("subject").agg(F.count("*").alias("documents"))
    named = reference.where("subject IS NOT NULL").select("subject").distinct().join(counted, "subject", "left")
    return named.select("subject", F.coalesce("documents", F.lit(0)).alias("documents")).withColumn("share", F.coalesce(F.try_divide("documents", total), F.lit(0.0)))
