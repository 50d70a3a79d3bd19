"""Sources: fragment files, and outside readers of documents and page images as pluggable functions.

Reading PDF files and recognising page images need libraries that are not part of this project; an adapter is a Python
function over the bytes of a file or page that Spark runs in batches, and its failures become a status, never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "str string, x double, y double, w double, h double, font string"
REGION = "map<string, array<struct<x: double, y: double, w: double, h: double>>>"


def parse_items(texts: DataFrame, text: str) -> DataFrame:
    """The other columns, item_idx and `i`, a fragment, for each element of a JSON array of fragments; what is none gives no row."""
    kept = [c for c in texts.columns if c != text]
    listed = F.from_json(text, f"array<struct<{ITEM.replace(' string', ': string').replace(' double', ': double')}>>")
    return texts.select(*kept, F.posexplode(listed).alias("item_idx", "i"))


def items_json(items: DataFrame) -> DataFrame:
    """(session_id, page_index, value): the fragments of a page as one JSON array, in their order. A page is one sheet."""
    fields = [f.split()[0] for f in ITEM.split(", ")]
    listed = F.array_sort(F.collect_list(F.struct("item_idx", F.struct(*fields).alias("i"))))
    return items.groupBy("session_id", "page_index").agg(F.to_json(F.transform(listed, lambda r: r["i"]), {"ignoreNullFields": "false"}).alias("value"))


def read_items(spark: SparkSession, path: str, session_id: str, page_index: int) -> DataFrame:
    """The fragments of a file that holds one JSON array; their order in the array becomes item_idx."""
    listed = parse_items(spark.read.text(path, wholetext=True), "value")
    return listed.select(F.lit(session_id).alias("session_id"), F.lit(page_index).alias("page_index"), "item_idx", "i.*")


def read_regions(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The image boxes of a file that maps page indexes to arrays of boxes."""
    whole = spark.read.text(path, wholetext=True)
    pages = whole.select(F.explode(F.from_json("value", REGION)).alias("page", "boxes"))
    return pages.select(F.lit(session_id).alias("session_id"), F.col("page").cast("int").alias("page_index"), F.explode("boxes").alias("b")).select("session_id", "page_index", "b.*")


def write_items(items: DataFrame, path: str) -> None:
    """Write fragments as JSON lines, a folder for each page; fragments of a page stay in order."""
    order = ["session_id", "page_index", "item_idx"]
    items.repartition("session_id", "page_index").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("session_id", "page_index").json(path)


def accepted_upload(mime_types: list[str]) -> str:
    """`pdf` or `images` for an upload of one PDF or exactly one image; anything else is an error."""
    if len(mime_types) == 1 and mime_types[0] == "application/pdf":
        return "pdf"
    if len(mime_types) == 1 and mime_types[0].startswith("image/"):
        return "images"
    raise ValueError("an upload is one PDF file or one image")


def read_documents(spark: SparkSession, path: str, reader: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """(path, status, rows): what an outside reader makes of each binary file; a failed file has status `failed` and no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _adapted(files, "path", reader, schema)


def recognise_pages(pages: DataFrame, recogniser: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """The same for page images (page_key, content): pass only the pages that need it, the filter stays below the adapter."""
    return _adapted(pages.select("page_key", "content"), "page_key", recogniser, schema)


def _adapted(df: DataFrame, key: str, reader: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, content in zip(pdf[key], pdf["content"]):
                try:
                    out.append((k, "ok", reader(bytes(content))))
                except Exception as e:  # noqa: BLE001  one bad page must not end the job
                    out.append((k, f"failed: {type(e).__name__}", []))
            yield pd.DataFrame(out, columns=[key, "status", "rows"])

    return df.mapInPandas(run, f"`{key}` {kind}, status string, rows array<struct<{schema}>>")


def read_rows(adapted: DataFrame) -> DataFrame:
    """The rows of the documents or pages that were read, with their order as item_idx."""
    key = adapted.columns[0]
    return adapted.where("status = 'ok'").select(key, F.posexplode("rows").alias("item_idx", "r")).select(key, "item_idx", "r.*")


def failed_pages(adapted: DataFrame) -> DataFrame:
    """The keys of the documents or pages that could not be read."""
    return adapted.where("status <> 'ok'").select(adapted.columns[0])


def resolve_fonts(items: DataFrame, fonts: DataFrame) -> DataFrame:
    """The fragments with the real name of each internal font id (font_id, name), or the id where there is none."""
    names = fonts.select(F.col("font_id").alias("font"), F.col("name"))
    return items.join(names, "font", "left").withColumn("font", F.coalesce("name", "font")).drop("name")
