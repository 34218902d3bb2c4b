"""Repeated windows of a fixed length over a corpus: what suffix and phrase deduplication share.

A window is `window` consecutive units (bytes or words) of one document. Every
window has an anchor: the leftmost of its `gram`-unit pieces with the least
hash. Equal windows have equal anchors at equal places, so windows can only
repeat where anchors do. Neighbouring windows with one anchor form a run, and
the units that a run's windows cover are its context.

1. Runs are dealt by anchor, as hashes and places of 40 bytes, and those of
   anchors found once are dropped; a task holds one row of an anchor at a time.
   Anchors that a sample shows to be very common are kept without a look and
   dealt in salted parts.
2. Runs left are grouped by anchor and digest of the context. Two runs of each
   group, if there are two, send their contexts, by anchor, to the exact check
   (suffix order, phrase automata), which compares their bytes: that a digest
   is found twice makes nothing go. The check alone decides which windows
   repeat; further runs of a group (same anchor, same 64-bit digest) share what
   it decides for the first two.
3. An anchor with too many different contexts for a task is split by content:
   of the units that its windows have beside the anchor, a window has half or
   more on one side, so the anchor grows by half of them to the left or to the
   right, which makes two runs with longer, rarer anchors. That goes on until
   no anchor is crowded; at the end an anchor is the window itself. The check is
   the same at every size.

Nothing here has a size that the input could outgrow: no filter, no broadcast
but that of the common anchors (at most 131,072 numbers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, bucketed, by_pid, cut, small

_PLACE_BITS = 20
_RUN = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


_BASE = 0x5851F42D4C957F2D | 5
_UP = _powers(_BASE, _RUN * 4)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _RUN * 4)


@dataclass(frozen=True)
class Units:
    """window and gram in units; words: units are words, else bytes."""

    words: bool
    window: int
    gram: int

    def __post_init__(self):
        if not 1 <= self.gram <= self.window <= 1 << 15:
            raise ValueError("1 <= gram <= window <= 32768 is needed")


class Parsed:
    """A document's units: a hash for each, and the content of a range of them."""

    def __init__(self, text: bytes, units: Units):
        if units.words:
            split = text.split()
            self.body = b" ".join(split)
            self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            self.ends = np.cumsum(lengths + 1) - 1
            self.starts = self.ends - lengths
        else:
            self.body, self.hashes = text, np.frombuffer(text, np.uint8)
            self.starts = None

    def content(self, a: int, b: int) -> bytes:
        return self.body[a:b] if self.starts is None else self.body[self.starts[a] : self.ends[b - 1]]


def window_runs(hashes: np.ndarray, ends: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and anchor place of each run. ends: for each unit, where its document ends."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n, k = len(hashes), units.gram
    windows, width = n - units.window + 1, units.window - k + 1
    if windows < 1:
        return none
    sums = np.r_[np.uint64(0), np.cumsum((hashes.astype(np.uint64) + np.uint64(1)) * _UP[:n], dtype=np.uint64)]
    grams = mixed((sums[k:] - sums[:-k]) * _DOWN[: n - k + 1])
    least = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:windows], least[width - size : width - size + windows])
    place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    valid = np.flatnonzero(ends[:windows] - np.arange(windows) >= units.window)
    if not len(valid):
        return none
    new = np.flatnonzero(np.r_[True, (place[valid[1:]] != place[valid[:-1]]) | (np.diff(valid) != 1)])
    return valid[new], np.diff(np.r_[new, len(valid)]), grams[place[valid[new]]], place[valid[new]]


def document_runs(docs: list[Parsed], units: Units) -> Iterator[tuple[np.ndarray, ...]]:
    """Document number, first window, number of windows, anchor of runs, and how far it is from the first window; short documents are taken together, long ones in pieces."""
    held: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(docs[i].hashes) for i in held])
        stops = np.cumsum(lengths)
        first, n, anchor, place = window_runs(np.concatenate([docs[i].hashes for i in held]), np.repeat(stops, lengths), units)
        which = np.searchsorted(stops, first, side="right")
        return np.array(held)[which], first - (stops - lengths)[which], n, anchor, place - first

    for i, doc in enumerate(docs):
        if len(doc.hashes) < units.window:
            continue
        if len(doc.hashes) > _RUN:
            for at in range(0, len(doc.hashes) - units.window + 1, _RUN):
                part = doc.hashes[at : at + _RUN + units.window - 1]
                first, n, anchor, place = window_runs(part, np.full(len(part), len(part)), units)
                yield np.full(len(first), i), first + at, n, anchor, place - first
            continue
        held.append(i)
        size += len(doc.hashes)
        if size >= _RUN:
            yield together()
            held, size = [], 0
    if held:
        yield together()


def packed(lo: np.ndarray | int, off: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | int:
    """A run's place in one number: first window, the anchor's distance from it, number of windows."""
    return (lo << 32) | (off << 16) | n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


#: Groups, each a list of (context, n_windows, anchor, other) by anchor in order of first place; anchor: where in the context it is; other: what stands at another place whose context has the same digest, None if there is none. Gives the spans to take from each context: (number, start, end, later), later being true for the context's later places, false for its first, None for both.
Check = Callable[[list[list[tuple[bytes, int, int, bytes | None]]], Units], Iterator[tuple[int, int, int, bool | None]]]
SPANS = "array<struct<start: int, end: int>>"
_SALTS, _SAMPLE = 256, 0.02
#: An anchor is common from this share of all runs on, or from so many runs.
_COMMON, _MANY, _MOST_COMMON = 1e-3, 1 << 20, 1 << 17


def stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pid, rid, id, text: written once, in buckets of pid, the partition that a row was read in; rid tells rows apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return bucketed(docs.select(F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), text.alias("text")), "pid")


def _place() -> list:
    """Columns that order places: id, nulls last, then row and place in it."""
    return [F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"), F.col("at")]


def _pid(rid: str) -> Column:
    """The partition that a row was read in."""
    return F.shiftright(rid, 33).cast("int")


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def found_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: rows in order of a and c. One row waits at most: the first of an anchor, until the next row says whether there is another."""
    names = ["a", "c", "id", "rid", "at"]
    waiting, last_a, last_c, in_a, in_c = None, None, None, 0, 0  # how many rows of the last anchor and of its last context were there

    for batch in batches:
        if not batch.num_rows:
            continue
        a, c, salt = (batch.column(x).to_numpy() for x in ("a", "c", "salt"))
        new_a = np.r_[a[0] != last_a, a[1:] != a[:-1]]
        new_c = new_a | np.r_[c[0] != last_c, c[1:] != c[:-1]]

        def ranks(new: np.ndarray, before: int) -> np.ndarray:
            """The number of each row in its group, from 0; before: of the group that goes on from the last batch."""
            starts = np.flatnonzero(new)
            base = np.r_[-before, starts]
            return np.arange(len(new)) - base[np.cumsum(new)]

        a_rank, c_rank = ranks(new_a, in_a), ranks(new_c, in_c)
        others = (a_rank > 0) | np.r_[a_rank[1:] > 0, False]  # the next row is of the same anchor
        if waiting is not None and a_rank[0] > 0:
            yield waiting
        waiting = None
        out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array((c_rank < 2).astype(np.int64))], [*names, "m"])
        keep = others | (salt > 0)
        if not keep[-1]:
            waiting = out.slice(len(a) - 1)
        yield out.filter(pa.array(keep))
        last_a, last_c, in_a, in_c = a[-1], c[-1], int(a_rank[-1]) + 1, int(c_rank[-1]) + 1


def _runs(rows: DataFrame, units: Units, in_order: bool) -> DataFrame:
    """a, c, id, rid, at of runs whose anchor is found again, and m: 1 on two rows of each anchor and context digest of a part (in_order: the first by place is one), if there are two, else 0."""
    kind, sc = _kind(rows), rows.sparkSession.sparkContext

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for _, _, _, anchor, _ in document_runs([Parsed(t, units) for t in as_bytes(batch.column(0))], units):
                yield pa.RecordBatch.from_arrays([_signed(anchor)], ["a"])

    seen = cut(rows.select("text").sample(_SAMPLE, 5).mapInArrow(anchors, "a long").groupBy("a").count().where("count >= 100"), "anchors")
    total = seen.agg(F.sum("count")).first()[0] or 0
    common = np.array(sorted(r.a for r in seen.where(F.col("count") >= min(_COMMON * total, _MANY * _SAMPLE)).orderBy(F.desc("count")).limit(_MOST_COMMON).collect()), np.int64)
    shared = sc.broadcast(common)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            docs = [Parsed(t, units) for t in as_bytes(batch.column(2))]
            rid = batch.column(0).to_numpy()
            for which, lo, n, anchor, off in document_runs(docs, units):
                content = (docs[d].content(a, a + m - 1 + units.window) for d, a, m in zip(which.tolist(), lo.tolist(), n.tolist(), strict=True))
                c = np.fromiter(map(xxhash.xxh3_64_intdigest, content), np.uint64, len(lo))
                a = anchor.view(np.int64)
                at = packed(lo, off, n)
                salt = np.where(np.isin(a, shared.value), 1 + (mixed(mixed(rid[which].astype(np.uint64)) ^ at.astype(np.uint64)) % np.uint64(_SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(a), _signed(c), batch.column(1).take(pa.array(which)), pa.array(rid[which]), pa.array(at), pa.array(salt)], ["a", "c", "id", "rid", "at", "salt"])

    # Ids matter for the order of places only.
    ids = F.col("id") if in_order else F.lit(None).cast(kind).alias("id")
    found = rows.select("rid", ids, "text").mapInArrow(find, f"a long, c long, id {kind}, rid long, at long, salt long")
    dealt = found.repartition("a", "salt").sortWithinPartitions("a", "c", *(_place() if in_order else []))
    return dealt.mapInArrow(found_again, f"a long, c long, id {kind}, rid long, at long, m long")


def _same_row() -> Column:
    return (F.col("pid") == F.col("__pid")) & (F.col("rid") == F.col("__rid"))


def _sent(rows: DataFrame, senders: DataFrame, units: Units) -> DataFrame:
    """senders (a, c, second, id, rid, at) with the contexts that they name."""
    kind = _kind(rows)
    each = senders.select(_pid("rid").alias("__pid"), F.col("rid").alias("__rid"), F.struct("a", "c", "second", "id", "at").alias("run"))
    by_row = by_pid(each, "__pid").groupBy("__pid", "__rid").agg(F.collect_list("run").alias("runs"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            runs = batch.column(2)
            which = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            a, c, second, ids, at = runs.flatten().flatten()
            docs: list[Parsed | None] = [Parsed(t, units) for t in as_bytes(batch.column(1))]
            where = at.to_numpy()
            content = [docs[d].content(x >> 32, (x >> 32) + (x & 0xFFFF) - 1 + units.window) for d, x in zip(which.tolist(), where.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, c, second, ids, batch.column(0).take(pa.array(which)), at, pa.array(content, pa.binary())], ["a", "c", "second", "id", "rid", "at", "content"])

    joined = rows.join(by_row.hint("shuffle_hash"), _same_row()).select("rid", "text", "runs")
    return joined.mapInArrow(send, f"a long, c long, second boolean, id {kind}, rid long, at long, content binary")


def _decided(sent: DataFrame, units: Units, check: Check, batch_bytes: int) -> DataFrame:
    """a, c, s, t: the spans to take from a context at its first place and at later ones; sent has a row for each a and c, and a second one if it is found again."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, size, last = [], [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            first, later = [[] for _ in keys], [[] for _ in keys]
            for i, start, end, which in check(groups, units):
                for held, wanted in ((first, which is not True), (later, which is not False)):
                    if wanted:
                        held[i].append({"start": start, "end": end})
            full = [i for i in range(len(keys)) if first[i] or later[i]]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i][0] for i in full], pa.int64()), pa.array([keys[i][1] for i in full], pa.int64()), pa.array([first[i] for i in full], kind), pa.array([later[i] for i in full], kind)], ["a", "c", "s", "t"])

        place = {}
        for batch in batches:
            for a, c, second, at, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if a != last:
                    if size >= batch_bytes:
                        yield from out()
                        keys, groups, size = [], [], 0
                    last, place = a, {}
                    groups.append([])
                if second:
                    groups[-1][place[c]][3] = content
                else:
                    place[c] = len(groups[-1])
                    keys.append((a, c))
                    groups[-1].append([content, at & 0xFFFF, at >> 16 & 0xFFFF, None])
                size += len(content)
        if groups:
            yield from out()

    dealt = sent.repartition("a").sortWithinPartitions("a", "second", *_place()).select("a", "c", "second", "at", "content")
    return dealt.mapInArrow(exact, f"a long, c long, s {SPANS}, t {SPANS}")


def split_run(n: int, core: tuple[int, int], window: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(first window, number of windows, core) of the one or two runs that a run of n windows around a core makes; cores count from the run's own first window."""
    lo, hi = core
    free = window - (hi - lo)
    half = (free + 1) // 2
    left = min(n, lo - half + 1)  # windows with half of the free units before the core
    if left > 0:
        yield 0, left, (lo - half, hi)
    right = max(0, lo - half + 1)
    if right < n:
        yield right, n - right, (lo - right, hi + free - half + 1 - right)


def _split(sent: DataFrame, units: Units) -> DataFrame:
    """The runs of crowded anchors with longer anchors, each with its parent (pa, pc) and where it starts in the parent's context."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2048):
            rows = []
            for row in batch.to_pylist():
                parsed, n = Parsed(row["content"], units), row["at"] & 0xFFFF
                core = row["at"] >> 16 & 0xFFFF
                for start, count, (lo, hi) in split_run(n, (core, core + (row["wide"] or units.gram)), units.window):
                    content = parsed.content(start, start + count - 1 + units.window)
                    a = xxhash.xxh3_64_intdigest(parsed.content(start + lo, start + hi), seed=1 + (hi - lo)) - (1 << 63)
                    c = xxhash.xxh3_64_intdigest(content, seed=7) - (1 << 63)
                    rows.append({"a": a, "c": c, "m": 1, "second": row["second"], "id": row["id"], "rid": row["rid"], "at": packed((row["at"] >> 32) + start, lo, count), "content": content, "wide": hi - lo, "pa": row["a"], "pc": row["c"], "shift": start})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kind = sent.schema["id"].dataType.simpleString()
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("m", pa.int64()), ("second", pa.bool_()), ("id", to_arrow_type(sent.schema["id"].dataType)), ("rid", pa.int64()), ("at", pa.int64()), ("content", pa.binary()), ("wide", pa.int32()), ("pa", pa.int64()), ("pc", pa.int64()), ("shift", pa.int32())])
    return sent.mapInArrow(halves, f"a long, c long, m long, second boolean, id {kind}, rid long, at long, content binary, wide int, pa long, pc long, shift int")


def _contexts(runs: DataFrame) -> DataFrame:
    """a, c, n (how many marked places), the first and another place of runs, the same if there is one only."""
    place = F.struct(*_place())
    return runs.where("m > 0").groupBy("a", "c").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("other"))


def _both() -> Column:
    """The first place of a context and the other one, if there is one, as senders."""
    send = lambda at, second: F.struct(F.lit(second).alias("second"), *(F.col(f"{at}.{c}").alias(c) for c in ("id", "rid", "at")))
    return F.inline(F.when(F.col("n") > 1, F.array(send("first", False), send("other", True))).otherwise(F.array(send("first", False))))


def _decisions(sent: DataFrame, contexts: DataFrame, units: Units, check: Check, hot: int, batch_bytes: int) -> DataFrame:
    """a, c, s, t for all contexts; those of crowded anchors through longer ones. sent: a row with content for each context, and how wide its anchor is if it isn't a gram."""
    crowded = cut(contexts.groupBy("a").agg(F.count("*").alias("d")).where(F.col("d") > hot).select("a"), "crowded")
    if crowded.isEmpty():
        return _decided(sent, units, check, batch_bytes)
    sent = cut(sent, "sent")
    few = _decided(sent.join(crowded, "a", "left_anti"), units, check, batch_bytes)
    parts = cut(_split(sent.join(crowded, "a", "left_semi"), units), "parts")
    own = cut(_contexts(parts), "contexts")
    several = cut(own.groupBy("a").agg(F.sum("n").alias("total")).where("total > 1").select("a"), "several")
    own = own.join(several, "a", "left_semi")
    ends = own.select(F.col("a").alias("fa"), F.col("c").alias("fc"), "n", "first", "other")
    here = F.struct(*_place())
    matched = parts.join(ends, (F.col("a") == F.col("fa")) & (F.col("c") == F.col("fc")))
    matched = matched.withColumns({"is_first": here.eqNullSafe(F.col("first")), "is_other": (F.col("n") > 1) & here.eqNullSafe(F.col("other"))})
    matched = cut(matched.drop("fa", "fc", "n", "first", "other"), "matched")
    reps = matched.where("is_first or is_other").select("a", "c", F.col("is_other").alias("second"), "id", "rid", "at", "content", "wide")
    deeper = cut(_decisions(reps, own, units, check, hot, batch_bytes), "deeper")
    matched = matched.where("not second")  # a parent's spans come from its first place
    moved = lambda spans: F.transform(spans, lambda x: F.struct((x["start"] + F.col("shift")).alias("start"), (x["end"] + F.col("shift")).alias("end")))
    back = matched.select("a", "c", "pa", "pc", "shift", "is_first").join(deeper, ["a", "c"]).select("pa", "pc", moved(F.when(F.col("is_first"), F.col("s")).otherwise(F.col("t"))).alias("s"), moved(F.col("t")).alias("t"))
    back = back.groupBy(F.col("pa").alias("a"), F.col("pc").alias("c")).agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("t")).alias("t"))
    return few.unionByName(back.select("a", "c", "s", "t"))


def repeated_spans(rows: DataFrame, units: Units, check: Check, *, keep_first: bool, hot: int, batch_bytes: int = 1 << 19) -> DataFrame:
    """rid, start, end: units of repeated windows. rows: as stored() gives them.

    keep_first leaves the first of equal windows, by id (nulls last), order of
    rows and place; check must then leave it too.
    """
    mine = cut(_runs(rows, units, keep_first), "runs")
    contexts = cut(_contexts(mine), "contexts")
    sent = _sent(rows, contexts.select("a", "c", _both()), units).withColumn("wide", F.lit(None).cast("int"))
    decided = _decisions(sent, contexts, units, check, hot, batch_bytes)
    if keep_first:
        decided = decided.join(contexts.select("a", "c", "first"), ["a", "c"])
    decided = cut(decided, "decided")
    runs = mine.select("a", "c", "id", "rid", "at").join(decided, ["a", "c"])
    spans = F.when(F.struct(*_place()).eqNullSafe(F.col("first")), F.col("s")).otherwise(F.col("t")) if keep_first else F.col("s")
    each = runs.select("rid", F.shiftright("at", 32).alias("lo"), F.explode(spans).alias("span"))
    return each.select("rid", (F.col("lo") + F.col("span.start")).alias("start"), (F.col("lo") + F.col("span.end")).alias("end"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with the array `spans` of their spans, null if none."""
    each = spans.select(_pid("rid").alias("__pid"), F.col("rid").alias("__rid"), F.struct("start", "end").alias("span"))
    by_row = by_pid(each, "__pid").groupBy("__pid", "__rid").agg(F.collect_set("span").alias("spans"))
    return rows.join(by_row.hint("shuffle_hash"), _same_row(), "left").select("id", "text", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans sorted, and joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out
