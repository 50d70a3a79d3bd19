"""Encoding of whole texts with a public byte-level BPE tokenizer, and decoding back to the same bytes.

The vocabulary is a rank file (base64 token, rank) at a path that is a parameter; the file is read once in each Python
worker and never copied. Texts longer than `long_text` characters are cut, before the merges, at places where the
pre-tokenisation pattern always ends a piece: between a character that is not white space and white space, and between a
letter and a digit. The ids are the same as those of the uncut text, and no merge ever sees a whole long text.

Defined results: null and empty texts give an empty list; special-token strings inside a text are ordinary text; ids are
those of the rank file; every row of the input gives one row, in any order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_TEXT = 16_384

_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def encoder(rank_file: str):
    """The tokenizer of a rank file, kept by each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long_text: int = LONG_TEXT) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about long_text characters; a run without a boundary stays whole."""
    at = 0
    while len(text) - at > long_text:
        cut = _BOUNDARY.search(text, at + long_text)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, rank_file: str = RANK_FILE, long_text: int = LONG_TEXT) -> np.ndarray:
    """The token ids of one text."""
    if not text:
        return np.empty(0, np.int32)
    enc = encoder(rank_file)
    if len(text) <= long_text:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    return np.concatenate([enc.encode_to_numpy(x, disallowed_special=()).astype(np.int32) for x in pieces(text, long_text)])


def decode(ids, rank_file: str = RANK_FILE) -> bytes:
    """The raw bytes of a list of ids. Bytes, since one token may hold a part of a character."""
    return encoder(rank_file).decode_bytes([int(i) for i in ids])


def encode_documents(df: DataFrame, text: str = "text", key: str = "doc_id", rank_file: str = RANK_FILE, long_text: int = LONG_TEXT) -> DataFrame:
    """(key, ids) for every row: ids is the list of token ids of the text, empty for null and empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(x.as_py(), rank_file, long_text) for x in batch.column(1)]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", rank_file: str = RANK_FILE, long_text: int = LONG_TEXT) -> DataFrame:
    """(key, tokens) for every row: the number of token ids of the text. The ids never leave the Python worker."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(encode(x.as_py(), rank_file, long_text)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")


def decode_documents(df: DataFrame, ids: str = "ids", key: str = "doc_id", rank_file: str = RANK_FILE) -> DataFrame:
    """(key, raw) for every row: the bytes that the ids stand for; null ids give no bytes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [decode(x.as_py() or [], rank_file) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [key, "raw"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, raw binary")
