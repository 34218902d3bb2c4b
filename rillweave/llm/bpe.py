"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts longer than `long_text` code points are cut where the splitting pattern
always has a boundary: before a space or line feed that follows a character
which isn't white space. No match of the pattern reaches over such a place and
none looks behind, so the ids of the pieces, one after another, are the ids of
the whole. A pattern for which that doesn't hold (some let punctuation take a
line feed along) is found out by probes, and long texts then stay whole.
Decoding joins the tokens' raw bytes; it never goes through text, so
ids that end inside a character come back exactly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

_BOUNDARY = re.compile(r"[^\s][ \n]")


def read_rank_file(path: str) -> bytes:
    """Read on the driver; executors get the bytes by broadcast, so the file need not exist there."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=16)
def cuts_are_safe(pattern: str) -> bool:
    """Whether the pattern has a boundary before white space after all kinds of characters."""
    split = regex.compile(pattern)
    kinds = ["a", "é", "1", ".", "'", "#", "日", "🙂", "it's", "a1", "1.", "_"]
    return all(len(x) in {m.start() for m in split.finditer(x + gap + y)} for x in kinds for gap in (" ", "\n", "  ", "\n\n", " \n", "\n ") for y in kinds)


def pieces(text: str, long_text: int) -> Iterator[str]:
    """text in pieces of about long_text code points, cut at safe boundaries only; a run without one stays whole."""
    at = 0
    while len(text) - at > long_text:
        found = _BOUNDARY.search(text, at + long_text - 1)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, long_text: int = 1 << 16) -> list[int]:
    if len(text) <= long_text or not cuts_are_safe(enc._pat_str):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, long_text):
        ids += enc.encode_ordinary(piece)
    return ids


def _shared(spark: SparkSession, rank_file: str):
    return spark.sparkContext.broadcast(read_rank_file(rank_file))


def _kind(rows: DataFrame) -> str:
    return rows.schema[0].dataType.simpleString()


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, long_text: int = 1 << 16, round_trip: bool = False) -> DataFrame:
    """id and ids (array of int) for each row, and with round_trip decoded (binary): what those ids decode to.

    Null counts as empty and gives no ids. Special tokens are ordinary text.
    Rows are coded each on its own, so repeated ids and rows are fine. Other
    columns are not carried.
    """
    shared = _shared(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for part in small(batches, 128):
            ids = [encode_text(enc, t or "", long_text) for t in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if round_trip:
                columns.append(pa.array(map(enc.decode_bytes, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {_kind(rows)}, ids array<int>" + ", decoded binary" * round_trip)


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and decoded (binary) for each row; null ids decode to no bytes."""
    shared = _shared(encoded.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for part in small(batches, 128):
            decoded = pa.array([enc.decode_bytes(ids or []) for ids in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], [id_col, "ids", "decoded"])

    rows = encoded.select(F.col(f"`{id_col}`"), "ids")
    return rows.mapInArrow(run, f"`{id_col}` {_kind(rows)}, ids array<int>, decoded binary")
