"""Quality rules: counts of words, symbols and repetition, and perplexity bands by language.

The language model is a modified Kneser-Ney model over the bytes of the
lower-cased text, white space as one blank, a model for each language. It grows
with what the corpus has to say and is never in one place:

1. Each task counts the n-grams of its documents, in parts of a bounded size,
   and sends each n-gram of a part once. Spark adds them up and keeps, with
   each n-gram's count, the parts that have it.
2. Spark derives the lower orders (continuation counts), the discounts and the
   interpolated probabilities by group-bys and joins of n-grams.
3. Each part gets the probabilities of its own n-grams back, as sorted arrays of
   64-bit n-grams and log probabilities, next to its documents' texts, and
   looks them up by binary search. All documents are counted, so no n-gram of a
   document is missing there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_bytes, cut, small

SYMBOLS = b"#*$%&|<>"
_RUN = 1 << 20
_PART = 1 << 25
_PARTS = 1 << 12
_HELD = 1 << 22


def language_number(lang: str | None) -> int:
    """23 bits that stand for a language beside the 40 of an n-gram of five bytes."""
    return xxhash.xxh64_intdigest("" if lang is None else "=" + lang) & 0x7FFFFF


def symbols(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def packed_ngrams(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the bodies, one for each byte, and how many each has. A body starts after order - 1 blanks."""
    pad = b" " * (order - 1)
    sizes = np.array([len(b) for b in bodies], np.int64)
    codes = np.frombuffer(b"".join(pad + b for b in bodies), np.uint8).astype(np.int64)
    grams = np.zeros(max(0, len(codes) - order + 1), np.int64)
    for k in range(order):
        grams |= codes[order - 1 - k : len(codes) - k] << (8 * k)
    starts = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    real = np.ones(len(grams), bool)
    for k in range(order - 1):  # n-grams that reach over the end of a body
        over = starts[1:] - 1 - k
        real[over[(over >= 0) & (over < len(real))]] = False
    return grams[real], sizes


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """Part number, rows and bodies; batches: pid, ..., text last. A row's part follows from the bytes of the task's rows before it, however they come in batches; parts have about _PART bytes."""
    size = 0
    for batch in small(batches, 256):
        if batch.num_rows:
            bodies = [symbols(t) for t in as_bytes(batch.column(batch.num_columns - 1))]
            before = size + np.cumsum([0, *map(len, bodies)])
            numbers = batch.column(0)[0].as_py() * _PARTS + before[:-1] // _PART
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                yield int(numbers[a]), batch.slice(a, b - a), bodies[a:b]
            size = int(before[-1])


def part_ngrams(rows: DataFrame, order: int) -> DataFrame:
    """part, lang, g and n: how often each part has each n-gram g; rows: pid, ..., lang, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def out(of: int) -> Iterator[pa.RecordBatch]:
            keys, n = _merged(held)
            for at in range(0, len(keys), 1 << 16):
                own = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), of)), pa.array((own >> 40).astype(np.int32)), pa.array(own & ((1 << 40) - 1)), pa.array(n[at : at + (1 << 16)])], ["part", "lang", "g", "n"])

        for number, batch, bodies in _in_parts(batches):
            if number != part:
                if held:
                    yield from out(part)
                part, held, size = number, [], 0
            langs = [language_number(x) for x in batch.column(batch.num_columns - 2).to_pylist()]
            for at, run in _runs(bodies):
                grams, sizes = packed_ngrams(run, order)
                own = np.array(langs[at : at + len(run)], np.int64)
                keys, n = np.unique((np.repeat(own, sizes) << 40) | grams, return_counts=True)
                held.append((keys, n))
                size += len(keys)
            if size > _HELD:
                held = [_merged(held)]
                size = 0
        if held:
            yield from out(part)

    return rows.mapInArrow(count, "part long, lang int, g long, n long")


def count_ngrams(each: DataFrame) -> DataFrame:
    """lang, g and c, the count in all documents, of part_ngrams."""
    return each.groupBy("lang", "g").agg(F.sum("n").alias("c"))


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about _RUN bytes, each with the place of its first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= _RUN:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """lang, g and p, the interpolated probability of the last byte of each n-gram (lang, g, c) after the others; below order 1 stands the uniform distribution."""
    tables = {order: counts.select("lang", "g", "c")}
    for n in range(order - 1, 0, -1):  # continuation counts: how many bytes come before
        tables[n] = tables[n + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("long")).alias("g")).agg(F.count("*").alias("c"))
        if n == order - 1:
            tables[n] = cut(tables[n], "continuations")
    below = None
    for n in range(1, order + 1):
        times = lambda i: F.sum(F.when(F.col("c") == i, 1.0).otherwise(0.0))
        seen = tables[n].groupBy("lang").agg(*(times(i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
        cuts = [F.when(F.col(f"n{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(float(i)))).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
        seen = cut(seen.select(F.col("lang").alias("of"), *cuts), "discounts")
        same = Window.partitionBy("lang", "context")
        held: list[Column] = [F.sum(F.when(F.least("c", F.lit(3)) == i, 1).otherwise(0)).over(same).alias(f"m{i}") for i in (1, 2, 3)]
        each = tables[n].withColumn("context", F.shiftright("g", 8)).select("lang", "g", "c", F.sum("c").over(same).alias("total"), *held).join(seen, F.col("lang") == F.col("of"))
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        weight = (F.col("m1") * F.col("d1") + F.col("m2") * F.col("d2") + F.col("m3") * F.col("d3")) / F.col("total")
        each = each.select("lang", "g", ((F.col("c") - less) / F.col("total")).alias("own"), weight.alias("weight"))
        if below is None:
            each = each.withColumn("lower", F.lit(1 / 256))
        else:
            lower = below.select(F.col("lang").alias("of"), F.col("g").alias("suffix"), F.col("p").alias("lower"))
            each = each.join(lower, (F.col("lang") == F.col("of")) & (F.col("g").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1).cast("long")) == F.col("suffix")))
        below = cut(each.select("lang", "g", (F.col("own") + F.col("weight") * F.col("lower")).alias("p")), "probabilities")
    return below


def log_perplexities(texts: DataFrame, rows: DataFrame, order: int) -> DataFrame:
    """The columns of rows (pid, id, lang, ..., text last) without pid and text, and log_perplexity (null without words). texts: the same rows, with pid, ..., lang and text, without what was worked out for them."""
    kept = rows.columns[1:-1]
    kind = rows.select(kept).schema
    each = cut(part_ngrams(texts, order), "grams")
    p = kneser_ney(cut(count_ngrams(each), "counts"), order)
    # Each part gets its own n-grams' probabilities: a row for each, as an n-gram may be in every part.
    found = each.select("part", "lang", "g").join(p, ["lang", "g"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted arrays for each part: n-grams as differences, then log probabilities."""
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            part, key, logp = (np.concatenate(x) for x in zip(*held, strict=True))
            sort = np.lexsort((key, part))
            part, key, logp = part[sort], key[sort], logp[sort]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            packer = zstandard.ZstdCompressor(3)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                data = packer.compress(np.diff(key[a:b], prepend=0).tobytes() + logp[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])]), pa.array([b - a], pa.int64()), pa.array([data], pa.binary())], ["part", "n", "model"])

        for batch in batches:
            key = (batch.column(1).to_numpy().astype(np.int64) << 40) | batch.column(2).to_numpy()
            held.append((batch.column(0).to_numpy(), key, np.log(batch.column(3).to_numpy()).astype(np.float32)))
            size += batch.num_rows
            if size > 1 << 20:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other columns as they are, bodies compressed together, a block for some rows."""
        packer = zstandard.ZstdCompressor(3)
        for number, batch, bodies in _in_parts(batches):
            sink = pa.BufferOutputStream()
            own = batch.select(list(range(1, batch.num_columns - 1)))
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_batch(own)
            sizes = np.array([len(b) for b in bodies], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packer.compress(sink.getvalue().to_pybytes())], pa.binary()), pa.array([packer.compress(sizes.tobytes() + b"".join(bodies))], pa.binary())], ["part", "rows", "bodies"])

    model = found.select("part", "lang", "g", "p").mapInArrow(chunks, "part long, n long, model binary").select("part", "n", "model", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("bodies"))
    packed = rows.mapInArrow(blocks, "part long, rows binary, bodies binary").select("part", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("model"), "rows", "bodies")
    dealt = model.unionByName(packed).repartition("part").sortWithinPartitions("part", F.col("n").isNull())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        part, held, keys, logp = None, [], np.zeros(0, np.int64), np.zeros(0, np.float32)
        for batch in small(batches, 64):
            for number, n, data, own, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != part:
                    part, held, keys, logp = number, [], np.zeros(0, np.int64), np.zeros(0, np.float32)
                if data is not None:
                    raw = unpacker.decompress(data)
                    held.append((np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.float32, n, 8 * n)))
                    continue
                if held:
                    keys, logp = (np.concatenate(x) for x in zip(*held, strict=True))
                    sort = np.argsort(keys)
                    keys, logp, held = keys[sort], logp[sort], []
                rest = pa.ipc.open_stream(unpacker.decompress(own)).read_next_batch()
                raw = unpacker.decompress(packed)
                sizes = np.frombuffer(raw, np.int64, rest.num_rows)
                ends = np.cumsum(sizes) + 8 * rest.num_rows
                bodies = [raw[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                langs = np.array([language_number(x) for x in rest.column(rest.schema.names.index("lang")).to_pylist()], np.int64)
                surprise = np.full(len(bodies), np.nan)
                for at, run in _runs(bodies):
                    grams, count = packed_ngrams(run, order)
                    wanted = (np.repeat(langs[at : at + len(run)], count) << 40) | grams
                    spot = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                    if len(wanted) and not (len(keys) and (keys[spot] == wanted).all()):
                        raise RuntimeError("rows came in another order than when they were counted")
                    full = np.flatnonzero(count)
                    if len(full):
                        starts = (np.cumsum(count) - count)[full]
                        surprise[at + full] = -np.add.reduceat(logp[spot].astype(float), starts) / count[full]
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(surprise, pa.float64(), mask=np.isnan(surprise))], [*kept, "log_perplexity"])

    return dealt.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", log_perplexity double")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of `size` words that are found twice or more."""
    if len(words) <= size:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    windows = codes[: len(codes) - size + 1]
    for k in range(1, size):  # a window's code stays under the number of windows times that of words
        _, windows = np.unique(windows * len(seen) + codes[k : len(codes) - size + 1 + k], return_inverse=True)
    twice = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1]) > 0))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = np.frombuffer(text.translate(None, SPACE_BYTES), np.uint8)
    lines = Counter(line for line in text.split(b"\n") if line.strip(SPACE_BYTES))
    return len(words), int(np.count_nonzero((solid & 0xC0) != 0x80)), len(text) - len(text.translate(None, SYMBOLS)), lines.total() - len(lines), repeated_words(words)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, order: int = 5, fence: float = 2.0, least_spread: float = 0.01, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and log_perplexity for each row.

    A row fails the base rules with fewer than min_words words or with over
    max_repeat_percent of them in repeated 3-word windows. A language's band
    lies `fence` times its interquartile range (at least least_spread) below
    the first and above the third quartile of the log perplexity, to four
    decimals, of its rows that don't fail; other such rows outside it are
    rejected. The quartiles are exact. order (2 to 5) is the number of bytes of
    an n-gram. Null languages are one language of their own. Null texts are
    empty, have perplexity null and fail. Rows are judged each on its own, so
    repeated ids and rows are fine. Other columns are not carried. docs must
    give its rows in the same partitions and order when read again, as files do.
    """
    if not 2 <= order <= 5:
        raise ValueError("order must be 2 to 5")
    rows = docs.select(F.spark_partition_id().alias("pid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts = list(zip(*map(base_counts, as_bytes(batch.column(3))), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in counts), batch.column(3)], ["pid", "id", "lang", *names, "text"])

    counted = rows.mapInArrow(base, f"pid int, id {kind}, lang string, " + ", ".join(f"{n} long" for n in names) + ", text string")
    scored = cut(log_perplexities(rows, counted, order), "scores")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = scored.withColumns({"base_failed": failed, "bin": F.round(F.col("log_perplexity") * 10_000).cast("long")})
    bins = scored.where("not base_failed").groupBy("lang", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    bins = bins.select("lang", "bin", F.sum("n").over(upto).alias("below"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    quartile = lambda share: F.min(F.when(F.col("below") >= share * F.col("all"), F.col("bin")))
    bands = bins.groupBy(F.col("lang").alias("band_lang")).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    spread = F.lit(fence) * F.greatest(F.col("q3") - F.col("q1"), F.lit(least_spread * 10_000))
    bands = cut(bands.select("band_lang", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")), "bands")
    inside = F.coalesce(F.col("bin").between(F.col("low"), F.col("high")), F.lit(False))
    judged = scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").withColumn("kept", ~F.col("base_failed") & inside)
    return judged.select(F.col("id").alias(id_col), *names, "base_failed", "kept", "log_perplexity")
