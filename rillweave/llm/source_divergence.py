"""Which sources of a language use words differently: exact divergences of all pairs of sources, and the terms that mark each.

1. Tasks count terms by (lang, source) in bounded tables, so a hot source is
   small before anything is shuffled; Spark adds up by (lang, term). Terms in
   too few documents of their language go.
2. Kept terms of a language are dealt into chunks by hash and numbered within
   them; a source's counts in a chunk are one packed row (positions, counts).
3. Sources of a language form blocks. A packed row goes to each tile (block by
   block) of its block, and a task holds one tile's rows of one chunk at a time:
   it adds each chunk's share to the tile's matrix of pairs. Long vocabularies
   are cut into spans of chunks, tasks of their own whose sums Spark adds up.

Terms that neither block of a tile has don't travel: each adds the same amount
to a pair, which is added once at the end. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, small

#: What p is scaled by: 1000 to the power of _STEPS.
_BASE, _STEPS = 1000, 3
#: Bytes of a term in small letters, all others as spaces; bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_PIECE = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of a bounded size."""
    at = 0
    while at < len(text):
        piece = text[at : at + _PIECE].translate(_FOLD)
        if at + _PIECE < len(text):
            # A term that may go on waits for the next piece, unless it fills this one.
            end = piece.rfind(b" ") + 1
            while not end:
                more = text[at + len(piece) : at + len(piece) + _PIECE].translate(_FOLD)
                stop = more.find(b" ")
                piece += more if stop < 0 else more[: stop + 1]
                end = len(piece) if stop >= 0 or not more else 0
            piece = piece[:end]
        at += len(piece)
        yield piece.split()


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, emptied whenever `most` entries are held; a row without term says that the group is there."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(g, s, term, n, docs[term]) for (g, s), (times, docs) in held.items() for term, n in [(None, 0), *times.items()]]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    for batch in small(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            if (lang, source) not in held:
                held[lang, source] = (Counter(), Counter())
                size += 1
            times, docs = held[lang, source]
            size -= len(times)
            own: set[bytes] = set()
            for terms in terms_of(text):
                times.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(times)
            if size >= most:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int, held: int) -> DataFrame:
    """(lang, source, term, n, total, first) of kept terms: n in the source, total in the language; first marks one row of a (lang, term). Rows without term: one for each group."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    parts = rows.mapInArrow(lambda b: _counted(b, held), "lang string, source string, term binary, n long, docs long")
    # One exchange serves the sums by source and by language.
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    judged = summed.withColumns({"in_docs": F.sum("docs").over(whole), "total": F.sum("n").over(whole), "first": F.row_number().over(whole.orderBy("source")) == 1})
    return judged.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "total", "first")


def group_table(kept: DataFrame, block: int) -> DataFrame:
    """A row for each (lang, source): its number in the language and block, size = N + 2 V of source and language, V and how many blocks there are."""
    real = F.col("term").isNotNull()
    langs = kept.groupBy("lang").agg(F.count_if(real & F.col("first")).alias("v"), F.coalesce(F.sum(F.when(real & F.col("first"), F.col("total"))), F.lit(0)).alias("lang_tokens"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("tokens")).join(langs, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumns({"place": place, "n_groups": F.count("*").over(Window.partitionBy("lang"))})
    size = lambda c: F.col(c) + 2 * F.col("v")
    return groups.select("lang", "source", "place", "v", size("tokens").alias("size"), size("lang_tokens").alias("lang_size"), F.floor(F.col("place") / block).cast("int").alias("block"), F.ceil(F.col("n_groups") / block).cast("int").alias("n_blocks"))


def share_column(count: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / size) without leaving 64 bits, three digits at a time; size at least count + 2."""
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(_STEPS):
        rest = rest * _BASE
        digit = F.call_function("div", rest, size)
        rest, out = rest - digit * size, out * _BASE + digit
    return out + 1


def share(count: np.ndarray, size: int) -> np.ndarray:
    """The same for an array of counts."""
    rest, out = count + 2, np.zeros_like(count)
    for _ in range(_STEPS):
        digit, rest = np.divmod(rest * _BASE, size)
        out = out * _BASE + digit
    return out + 1


def gap_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def packed_vectors(kept: DataFrame, groups: DataFrame, chunk_terms: int) -> DataFrame:
    """(lang, chunk, source, pos, n): a source's counts of a chunk's terms, by the terms' numbers in the chunk."""
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk_terms))
    sized = kept.where("term is not null").join(groups.select("lang", "source", "v"), ["lang", "source"])
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("term"), n_chunks).cast("int"))
    numbered = dealt.withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    return numbered.groupBy("lang", "chunk", "source").agg(F.collect_list(F.struct("pos", "n")).alias("e")).select("lang", "chunk", "source", F.col("e.pos").alias("pos"), F.col("e.n").alias("n"))


class Tile:
    """The matrix of one tile: places and sizes of both blocks, sums of pairs so far, and how many terms were seen."""

    def __init__(self, key: tuple, members: list[tuple[int, int, int]]):
        self.key = key
        self.sides = [[(place, size) for block, place, size in members if block == b] for b in key[1:3]]
        self.sums = np.zeros(tuple(map(len, self.sides)), np.int64)
        self.seen = 0

    def add(self, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """One chunk: vectors by place."""
        union = np.unique(np.concatenate([pos for pos, _ in vectors.values()]))
        self.seen += len(union)

        def dense(place: int, size: int) -> np.ndarray:
            counts = np.zeros(len(union), np.int64)
            if place in vectors:
                pos, n = vectors[place]
                counts[np.searchsorted(union, pos)] = n
            return share(counts, size)

        right = np.stack([dense(*g) for g in self.sides[1]])
        for i, g in enumerate(self.sides[0]):
            p = dense(*g)
            self.sums[i] += ((right - p) ** 2 // (right + p)).sum(axis=1)

    def pairs(self) -> list[tuple]:
        """(lang, a, b, value, seen) with a before b."""
        (lang, *_), (left, right) = self.key, self.sides
        return [(lang, a, b, int(self.sums[i, j]), self.seen) for i, (a, _) in enumerate(left) for j, (b, _) in enumerate(right) if a < b]


def _by_tile(rows: Iterable[tuple]) -> Iterator[Tile]:
    """rows: key (lang, lo, hi, span), chunk (-1 for the members of both blocks), block, place, size, pos, n; sorted."""
    for key, own in groupby(rows, key=lambda r: r[0]):
        tile, members = None, []
        for chunk, part in groupby(own, key=lambda r: r[1]):
            if chunk < 0:
                members = [r[2:5] for r in part]
                continue
            tile = tile or Tile(key, members)
            tile.add({place: (pos, n) for _, _, _, place, _, pos, n in part})
        yield tile or Tile(key, members)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in small(batches, 64):
            names = ["lang", "lo", "hi", "span", "chunk", "block", "place", "size"]
            for i, (*key, chunk, block, place, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                yield tuple(key), chunk, block, place, size, batch.column("pos")[i].values.to_numpy(), batch.column("n")[i].values.to_numpy()

    for tile in _by_tile(rows()):
        found = tile.pairs()
        if found:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["lang", "a", "b", "value", "seen"])


def pair_values(kept: DataFrame, groups: DataFrame, *, chunk_terms: int, span_chunks: int) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    about = groups.select("lang", "source", "place", "size", "block", "n_blocks", "v")
    vectors = packed_vectors(kept, groups, chunk_terms).join(about.drop("v"), ["lang", "source"])
    vectors = vectors.withColumn("span", F.floor(F.col("chunk") / span_chunks).cast("int"))
    spans = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.ceil(F.col("v") / chunk_terms) / span_chunks) - 1).cast("int"))
    # The members of each block go to its tiles before any counts do.
    members = about.withColumn("span", F.explode(spans)).select("lang", F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("pos"), F.array().cast("array<bigint>").alias("n"), "place", "size", "block", "n_blocks", "span")
    both = vectors.select(members.columns).unionByName(members)
    tiles = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("lo"), F.greatest(j, "block").alias("hi")))
    dealt = both.withColumn("t", F.explode(tiles)).select("lang", "t.lo", "t.hi", "span", "chunk", "block", "place", "size", "pos", "n")
    dealt = dealt.repartition("lang", "lo", "hi", "span").sortWithinPartitions("lang", "lo", "hi", "span", "chunk", "block", "place")
    sums = dealt.mapInArrow(_tiles, "lang string, a int, b int, value long, seen long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # Terms that neither source has: each adds the same, and every pair has its rows, also where no term is kept.
    none = F.when(F.col("v") > 0, share_column(F.lit(0).cast("long"), F.col("size")))
    side = lambda at: about.select("lang", F.col("place").alias(at), F.col("source").alias(f"{at}_source"), none.alias(f"{at}_none"), F.col("v").alias(f"{at}_v"))
    named = sums.join(side("a"), ["lang", "a"]).join(side("b").drop("b_v"), ["lang", "b"])
    unseen = (F.col("a_v") - F.col("seen")) * gap_column(F.col("a_none"), F.col("b_none"))
    valued = named.select("lang", "a_source", "b_source", F.coalesce(F.col("value") + unseen, F.lit(0).cast("long")).alias("value"))
    ways = F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))
    return valued.withColumn("w", F.explode(ways)).select("lang", "w.source", "w.item", "value")


def marking_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that a source uses more than its language does."""
    sized = kept.where("term is not null and n > 0").join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
    p, q = share_column(F.col("n"), F.col("size")), share_column(F.col("total"), F.col("lang_size"))
    return sized.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.col("term").alias("item"), gap_column(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, min_docs: int = 10, top: int = 10, block: int = 8, chunk_terms: int = 1 << 14, span_chunks: int = 64, held: int = 1 << 18) -> DataFrame:
    """lang, source, part, item, value and rank (from 1 per group and part: value descending, item's UTF-8 bytes ascending).

    Part `pair`: item is each other source of the language, all ranks. Part
    `term`: item is a kept term that the source uses more than the language
    does, the first `top` ranks. Null lang, source and text count as empty, as
    do empty ones; a group without terms is paired like any other; a language
    without kept terms has pairs of value 0; a lone source has no pairs.
    Repeated rows count as documents each. Other columns are not read. block
    bounds a tile, chunk_terms and span_chunks what a task reads, held the
    entries of a task's count table.
    """
    kept = cut(term_counts(docs, lang_col, source_col, text_col, min_docs, held), "terms")
    groups = cut(group_table(kept, block), "groups")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(pair_values(kept, groups, chunk_terms=chunk_terms, span_chunks=span_chunks)).withColumn("part", F.lit("pair"))
    terms = ranked(marking_terms(kept, groups)).where(F.col("rank") <= top).withColumns({"part": F.lit("term"), "item": F.col("item").cast("string")})
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))
