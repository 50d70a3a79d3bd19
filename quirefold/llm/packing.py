"""Cost-balanced packing of texts into containers of a fixed number of tokens.

A sequence costs `linear` for each of its tokens and `quadratic` for each pair of tokens that attend to each other within
one document, so a document of n tokens costs linear * n + quadratic * n * n. Documents are taken in descending order
of tokens and each goes to the sequence of the lowest cost that has room for it.

Documents are first dealt at random (by a hash of their key) into groups of about `group_rows` rows, and each group is
packed on its own: no task ever holds more than a group, and only (key, tokens) is shuffled. A sequence is opened only
where a document finds room in none; opening as many as the tokens need beforehand spreads middling documents so evenly
that too many sequences end with room that nothing fits. A document of more tokens than the capacity is split: its full
pieces fill containers of their own and its rest is packed like any other.

Defined results: a null or empty text has no tokens and no row, nor has a row without a key; a repeated key counts once; each token of each other text
lies in exactly one row's [tok_start, tok_end).
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import tokens
from quirefold.session import spread

CAPACITY = 4_096
LINEAR, QUADRATIC = 1.0, 1.0 / 4_096
GROUP_ROWS = 4_000


def pack(sizes: list[tuple], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple]:
    """Rows (container, key, tok_start, tok_end) for (key, tokens) pairs; containers count from 0."""
    cost = lambda n: linear * n + quadratic * n * n
    rows, whole = [], 0
    open_items = []
    for key, n in sizes:
        start = 0
        while n - start > capacity:
            rows.append((whole, key, start, start + capacity))
            whole, start = whole + 1, start + capacity
        if n > start:
            open_items.append((n - start, start, key))
    open_items.sort(key=lambda x: (-x[0], x[2], x[1]))
    heap: list[tuple[float, int, int]] = []
    opened = whole
    least = max(1, open_items[-1][0]) if open_items else 1
    for n, start, key in open_items:
        passed = []
        while heap and heap[0][2] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            spent, at, room = heapq.heappop(heap)
        else:
            spent, at, room = 0.0, opened, capacity
            opened += 1
        rows.append((at, key, start, start + n))
        if room - n >= least:
            heapq.heappush(heap, (spent + cost(n), at, room - n))
        for x in passed:
            heapq.heappush(heap, x)
    return rows


def pack_documents(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS, rank_file: str = tokens.RANK_FILE) -> DataFrame:
    """One row (container, key, tok_start, tok_end, tokens) for each document, or piece of a document over the capacity."""
    groups = max(1, -(-df.select(key).count() // group_rows))
    kind = df.schema[key].dataType.simpleString()
    sized = tokens.count_tokens(spread(df.select(key, text).where(F.col(key).isNotNull())), text, key, rank_file).where("tokens > 0")
    # A stated number of partitions: the rows are few bytes but much work, and would else be coalesced into few tasks.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(groups, 10_000))
    dealt = sized.dropDuplicates([key]).withColumn("grp", F.pmod(F.xxhash64(key), F.lit(groups))).repartition(tasks, "grp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iloc[0])
        out = pack(list(zip(pdf[key], pdf["tokens"].tolist())), capacity, linear, quadratic)
        return pd.DataFrame([(f"{grp}-{c}", k, a, b, b - a) for c, k, a, b in out], columns=["container", key, "tok_start", "tok_end", "tokens"])

    return dealt.groupBy("grp").applyInPandas(run, f"container string, `{key}` {kind}, tok_start bigint, tok_end bigint, tokens bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """(containers, tokens, fill, cost_spread): how much of the capacity is used, and the largest cost of a container as a multiple of the mean."""
    cost = F.sum(F.lit(linear) * F.col("tokens") + F.lit(quadratic) * F.col("tokens") * F.col("tokens"))
    used = packed.groupBy("container").agg(F.sum("tokens").alias("used"), cost.alias("cost"))
    share = (F.sum("used") / (F.count("*") * F.lit(capacity))).alias("fill")
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), share, (F.max("cost") / F.avg("cost")).alias("cost_spread"))


def cover(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(documents, overfull, gaps, needless): documents placed, containers over the capacity, places where a document's
    pieces do not follow on each other from 0, and documents that are split though they fit. All but the first must be 0."""
    over = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("overfull"))
    pieces = Window.partitionBy(key).orderBy("tok_start")
    follows = packed.withColumn("gap", F.col("tok_start") != F.coalesce(F.lag("tok_end").over(pieces), F.lit(0)))
    each = follows.groupBy(key).agg(F.count_if("gap").alias("gaps"), F.count("*").alias("pieces"), F.max("tok_end").alias("size"))
    whole = each.agg(F.count("*").alias("documents"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity)).alias("needless"))
    return whole.select("documents", over.scalar().alias("overfull"), "gaps", "needless")
