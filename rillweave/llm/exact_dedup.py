"""Exact deduplication: two passes of Bloom filters, then a group-by of possible repeats only.

Pass one sets, for the digest of every normalised text, its slots in a filter
"seen"; slots set a second time go to a filter "seen again". Both filters merge
like saturating counters: or the bits, and carry where both sides had a slot.
Pass two tests each row: when all its slots were seen again it may have a twin
and is shuffled (digest and ids only, never the text); any other row is proven
unique and passes straight through. False positives cost a shuffled row, never
a wrong result.

A filter has 16 slots or more a row, which lets about one unique row in 70
through. Beyond the rows that one broadcast of bounded size can serve, digests
are written in shards by their prefix, and each shard has two passes and a
filter of its own, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, text_or_empty, unused

CHUNK_BITS = 1 << 16
_SPARSE = CHUNK_BITS // 16


def _set(bitmap: np.ndarray, slots: np.ndarray) -> None:
    """Set sorted distinct slots."""
    if len(slots):
        at = slots >> 3
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bitmap[at[first]] |= np.bitwise_or.reduceat((1 << (slots & 7)).astype(np.uint8), first)


def _test(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _pack(bitmap: np.ndarray) -> bytes:
    """A chunk's bitmap; few slots are listed instead."""
    slots = np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))
    return slots.astype(np.uint16).tobytes() if len(slots) < _SPARSE else bitmap.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == CHUNK_BITS // 8:
        return np.frombuffer(data, np.uint8)
    bitmap = np.zeros(CHUNK_BITS // 8, np.uint8)
    _set(bitmap, np.frombuffer(data, np.uint16).astype(np.int64))
    return bitmap


def _slots(batch: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) & (bits - 1) for i in (0, 1)]


def slot_filter(hashes: DataFrame, bits: int) -> bytes:
    """The bitmap of slots that rows of two 64-bit hash columns set twice or more, of bits / 8 bytes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}

        def chunk(of: dict[int, np.ndarray], c: int) -> np.ndarray:
            if c not in of:
                of[c] = np.zeros(CHUNK_BITS // 8, np.uint8)
            return of[c]

        for batch in batches:
            first, second = _slots(batch, bits)
            # A row whose two slots coincide counts that slot once.
            slots, n = np.unique(np.r_[first, second[second != first]], return_counts=True)
            edges = np.flatnonzero(np.r_[True, np.diff(slots // CHUNK_BITS) != 0, True]) if len(slots) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                c, inside = int(slots[a]) // CHUNK_BITS, slots[a:b] % CHUNK_BITS
                one = chunk(once, c)
                again = inside[(n[a:b] > 1) | _test(one, inside)]
                if len(again):
                    _set(chunk(twice, c), again)
                _set(one, inside)
        for c, one in once.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int64()), "once": [_pack(one)], "twice": [_pack(twice[c]) if c in twice else b""]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for c, once, twice in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                one, two = held.setdefault(c, (np.zeros(CHUNK_BITS // 8, np.uint8), np.zeros(CHUNK_BITS // 8, np.uint8)))
                more = _unpack(once)
                two |= _unpack(twice) | (one & more)
                one |= more
        for c, (_, two) in held.items():
            if two.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int64()), "slots": [_pack(two)]})

    parts = hashes.mapInArrow(fill, "chunk long, once binary, twice binary")
    merged = parts.repartition("chunk").mapInArrow(merge, "chunk long, slots binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most bits / 8 bytes
        at = row.chunk * (CHUNK_BITS // 8)
        bitmap[at : at + CHUNK_BITS // 8] = _unpack(bytes(row.slots))
    return bitmap.tobytes()


def shard_plan(rows: int, filter_bits: int, bits_per_row: int) -> tuple[int, int]:
    """How many shards rows need, and the slots of each one's filter: a power of two, at most filter_bits."""
    wanted = max(CHUNK_BITS, rows * bits_per_row)
    bits = min(filter_bits, 1 << (wanted - 1).bit_length())
    return -(-wanted // bits), bits


def _judged_shard(rows: DataFrame, bits: int) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256, rid for the rows of a shard."""
    rows = rows.withColumns({"h1": F.xxhash64("text_sha256"), "h2": F.xxhash64("text_sha256", F.lit(1))})
    shared = rows.sparkSession.sparkContext.broadcast(slot_filter(rows.select("h1", "h2"), bits))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            first, second = _slots(batch.select(["h1", "h2"]), bits)
            maybe = _test(bitmap, first) & _test(bitmap, second)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maybe)], ["id", "text_sha256", "rid", "maybe"])

    kind = rows.schema["id"].dataType.simpleString()
    tested = rows.select("id", "text_sha256", "rid", "h1", "h2").mapInArrow(test, f"id {kind}, text_sha256 string, rid long, maybe boolean")
    unique = tested.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "rid")
    again = tested.where("maybe")
    groups = again.groupBy("text_sha256").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))).alias("first"), F.count("*").alias("group_size"))
    # Written first: the join is planned by its size, and a hot digest can be split.
    groups = cut(groups.where("group_size > 1").select("text_sha256", "first", "group_size"), "groups")
    keep = F.coalesce(F.col("first.id"), F.when(F.col("first").isNull(), F.col("id")))
    kept = F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True))
    repeated = again.join(groups, "text_sha256", "left").select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256", "rid")
    return unique.unionByName(repeated)


def judged_rows(docs: DataFrame, id_col: str, text_col: str, rid: Column, *, filter_bits: int = 1 << 28, bits_per_row: int = 16) -> DataFrame:
    """exact_dedup's columns (the id as `id`) and rid, which tells the rows of docs apart."""
    if filter_bits < CHUNK_BITS or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two of at least 65536")
    digest = F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE_CLASS, " "), 256)
    shards, bits = shard_plan(docs.count(), filter_bits, bits_per_row)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("text_sha256"), rid.alias("rid"))
    if shards == 1:
        return _judged_shard(cut(rows, "digests"), bits)
    prefix = F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long")
    rows = cut(rows.withColumn("shard", F.shiftright(prefix * shards, 32).cast("int")), "digests", ["shard"])
    found = None
    for shard in range(shards):  # one filter at a time
        judged = cut(_judged_shard(rows.where(F.col("shard") == shard), bits), "judged")
        found = judged if found is None else found.unionByName(judged)
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, filter_bits: int = 1 << 28, bits_per_row: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes
    one space; null counts as empty. The row with the smallest id stays, null
    ids last; of rows that share that id exactly one stays. filter_bits, a
    power of two of at least 65,536, bounds the broadcast filter (32 MB by
    default, for 16 million rows at 16 bits a row); more rows make more shards.
    Other columns are not carried.
    """
    judged = judged_rows(docs, id_col, text_col, F.monotonically_increasing_id(), filter_bits=filter_bits, bits_per_row=bits_per_row)
    return judged.drop("rid").withColumnRenamed("id", id_col)


def keep_first_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without exact copies: exactly the rows that exact_dedup marks as kept, with all columns; of rows that repeat id and text one stays."""
    rid = unused(docs, "rid")
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    gone = cut(judged_rows(rows, id_col, text_col, F.col(rid), **options).where("not kept").select(F.col("rid").alias(rid)), "gone")
    return rows.join(gone, rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
