"""Substring deduplication of words by repeated-phrase automata.

Candidate regions come from anchors.py: every part of every document whose
anchor is found again. Within a shard of them, windows found twice are
confirmed and joined to the longest passages that consist of such windows; the
passages are compiled to an Aho-Corasick automaton over word numbers, and all
contexts of the shard stream through it, which finds each occurrence of each
passage. A document's other parts hold no anchor of a passage, and equal
contexts need to stream once. Windows are counted in words as they stand, for a
context whose digest is found again at two of its places; further places of the
digest go the way of these two. The automata decide which words go.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Units, merged, repeated_spans, stored, with_spans
from .common import as_bytes, small


def passages(contexts: list[tuple[tuple[int, ...], tuple[int, ...] | None]], window: int) -> set[tuple[int, ...]]:
    """The longest runs of words, within contexts, all of whose windows start at two places or more; beside a context what stands at another place, if anything."""
    times = Counter(c[i : i + window] for both in contexts for c in both if c for i in range(len(c) - window + 1))
    found = set()
    for c, _ in contexts:
        start = None
        for i in range(len(c) - window + 2):
            twice = i <= len(c) - window and times[c[i : i + window]] > 1
            if twice and start is None:
                start = i
            elif not twice and start is not None:
                found.add(c[start : i + window - 1])
                start = None
    return found


def automaton(patterns: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        out.add_word(p, len(p))
    out.make_automaton()
    return out


def _check(groups: list[list[tuple[bytes, int, int, bytes | None]]], units: Units) -> Iterator[tuple[int, int, int, None]]:
    numbers: dict[bytes, int] = {}
    numbered = lambda c: tuple(numbers.setdefault(w, len(numbers)) for w in c.split(b" "))
    contexts = []
    for g in groups:
        for c, _, _, other in g:
            own = numbered(c)
            contexts.append((own, None if other is None else own if other == c else numbered(other)))
    patterns = passages(contexts, units.window)
    if not patterns:
        return
    shard = automaton(patterns)
    for i, (c, _) in enumerate(contexts):
        for last, length in shard.iter(c):
            yield i, last + 1 - length, last + 1, None


def phrase_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, gram: int | None = None, hot: int = 8192) -> DataFrame:
    """id, n_words, spans (removed word ranges) and kept (the words left, joined by one space) for each row.

    Words are runs of anything but ASCII white space, unchanged. Takes out each
    word covered by a window of `window` words that also starts elsewhere in
    the corpus, the same text included. Null texts have no words. Rows that are
    equal in id and text count as separate places. Other columns are not
    carried. hot bounds the contexts of an anchor in one task; what has more is
    split by longer anchors (see anchors.py).
    """
    units = Units(True, window, gram or max(1, window // 4))
    rows = stored(docs, id_col, text_col)
    spans = repeated_spans(rows, units, _check, keep_first=False, hot=hot, batch_bytes=1 << 18)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            words, found = [t.split() for t in as_bytes(part.column(1))], [merged(s) for s in part.column(2).to_pylist()]
            kept = []
            for w, spans in zip(words, found, strict=True):
                left, last = [], 0
                for a, b in spans:
                    left += w[last:a]
                    last = b
                kept.append(b" ".join(left + w[last:]).decode())
            ranges = pa.array([[{"start": a, "end": b} for a, b in s] for s in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), ranges, pa.array(kept, pa.string())], [id_col, "n_words", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return with_spans(rows, spans).mapInArrow(remove, f"`{id_col}` {kind}, n_words long, spans array<struct<start: bigint, end: bigint>>, kept string")
