"""Suffix-array deduplication of bytes by longest-previous-factor arrays.

Candidate regions come from anchors.py: the surroundings of an anchor, which
equal strings have at equal places. Aligned at the anchor, the suffixes of all
its surroundings are put in suffix order, column by column from right to left.
In suffix order the previous and the next suffix of a smaller position give the
longest earlier match of each place; mirrored, they give the longest later one.
A byte is removed when a string of the full length that covers it has such a
match. Surroundings whose digest is found again are there twice, as they stand
at two places, so that suffix order finds them equal or not; further places of
the same digest go the way of these two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Units, merged, repeated_spans, stored, with_spans
from .common import as_bytes, remove_spans, small


class AlignedSuffixes:
    """The suffixes of byte strings in groups, column by column from right to left, in suffix order within groups.

    The strings of a group are aligned at a column. The order at a column
    follows from that at the next one by a stable sort on one byte, and the
    common prefixes of neighbours, up to depth, from those there. Beyond its
    ends a string is padded with zeros.
    """

    def __init__(self, strings: list[bytes], group: np.ndarray, align: np.ndarray, depth: int):
        """group: ascending numbers; align: the place in each string that stands at column 0."""
        sizes = np.array([len(x) for x in strings], np.int64)
        self.depth, self.left = depth, int(align.max())
        self.columns = np.zeros((self.left + int((sizes - align).max()), len(strings)), np.uint8)
        row = np.repeat(np.arange(len(strings)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - (self.left - align), sizes)
        self.columns[place, row] = np.frombuffer(b"".join(strings), np.uint8)
        self.group = group.astype(np.int64)

    def orders(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, strings in suffix order within groups, common prefix of each with the one before, 0 at the start of a group)."""
        order = np.arange(len(self.group))
        same_group = np.r_[False, self.group[1:] == self.group[:-1]]
        common = np.where(same_group, self.depth, 0)  # nothing but padding yet
        for at in range(len(self.columns) - 1, -1, -1):
            byte = self.columns[at][order]
            key = (self.group << 8) | byte  # groups keep their places in the order
            equal = np.r_[False, key[1:] == key[:-1]]
            if (key[1:] >= key[:-1]).all():
                common = np.where(equal, np.minimum(common + 1, self.depth), 0)
            else:
                new = np.argsort(key, kind="stable")
                key = key[new]
                equal = np.r_[False, key[1:] == key[:-1]]
                before = np.r_[0, new[:-1]]
                least = common[new]
                far = np.flatnonzero(equal & (new - before > 1))  # others stood between the two
                if len(far):
                    ends = np.column_stack([before[far] + 1, new[far] + 1]).ravel()
                    least[far] = np.minimum.reduceat(np.r_[common, 0], ends)[::2]
                common = np.where(equal, np.minimum(least + 1, self.depth), 0)
                order = order[new]
            yield at - self.left, order, common


def _previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each of the values (0 or more) the place of the last one before it that isn't larger; -1 if none. Jumps over places that are known to be larger, all at a time."""
    at, ext = np.arange(len(values)) - 1, np.r_[values, -1]
    left = np.flatnonzero(ext[at] > values)
    for _ in range(64):
        if not len(left):
            return at
        at[left] = at[at[left]]
        left = left[ext[at[left]] > values[left]]
    stack: list[int] = []  # long chains are left: one by one
    for i, x in enumerate(values.tolist()):
        while stack and values[stack[-1]] > x:
            stack.pop()
        at[i] = stack[-1] if stack else -1
        stack.append(i)
    return at


def factors_of_depth(strings: list[bytes], group: np.ndarray, align: np.ndarray, first: np.ndarray, count: np.ndarray, depth: int, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """string, place, found: for each of the `count` places from `first` on of each string, whether the longest previous factor at that place reaches `depth` bytes.

    Factors are looked for among the same column's places of the group's
    strings, and a string's number is its position: previous means in a string
    with a smaller number. With `later` the longest later factor counts too.
    """
    suffixes = AlignedSuffixes(strings, group, align, depth)
    strings_at, columns, blocks, total = [], [], [], 0
    begin = first - align
    for column, order, common in suffixes.orders():
        if column > int((begin + count).max()) or column < int(begin.min()):
            continue
        block = np.cumsum(common < depth)  # neighbours in suffix order that share depth bytes
        real = np.flatnonzero((begin[order] <= column) & (column < begin[order] + count[order]))
        if len(real):
            strings_at.append(order[real])
            columns.append(np.full(len(real), column))
            blocks.append(block[real] + total)
            total += len(order) + 1
    if not strings_at:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    number, column, block = (np.concatenate(x) for x in (strings_at, columns, blocks))
    found = np.zeros(len(number), bool)
    spot = lambda at: np.r_[block, -1][at]
    wide = len(strings) + 1
    for values in (number, number.max() - number) if later else (number,):
        # Other blocks come out smaller on either side, so that no search goes on beyond a block.
        at = _previous_smaller(block * wide + values)
        back = _previous_smaller(((total - block) * wide + values)[::-1])[::-1]
        found |= (spot(at) == block) | (spot(np.where(back >= 0, len(values) - 1 - back, -1)) == block)
    return number, column + align[number], found


def _check(keep_first: bool):
    """Longest previous factors over the contexts of each anchor in order of first place, and at the end over what stands at other places of those found again; without keep_first the longest later ones too."""

    def check(groups: list[list[tuple[bytes, int, int, bytes | None]]], units: Units) -> Iterator[tuple[int, int, int, bool | None]]:
        strings, owner, group, align, counts, second, n = [], [], [], [], [], [], 0
        for number, contexts in enumerate(groups):
            for again in (False, True):
                for i, (content, count, place, other) in enumerate(contexts):
                    if not again or (other is not None and len(other) == len(content)):
                        strings.append(other if again else content)
                        owner.append(n + i)
                        group.append(number)
                        align.append(place)
                        counts.append(count)
                        second.append(again)
            n += len(contexts)
        which, inside, found = factors_of_depth(strings, np.array(group), np.array(align), np.zeros(len(strings), np.int64), np.array(counts), units.window, not keep_first)
        if not keep_first:  # a context's spans are those of its first place
            found &= ~np.array(second)[which]
        which, inside = which[found], inside[found]
        if not len(which):
            return
        sort = np.lexsort((inside, which))
        which, inside = which[sort], inside[sort]
        new = np.flatnonzero(np.r_[True, (np.diff(inside) != 1) | (np.diff(which) != 0)])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(which)], strict=True):
            i = int(which[a])
            yield owner[i], int(inside[a]), int(inside[b - 1]) + units.window, second[i] if keep_first else None

    return check


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 200, keep_first: bool = True, gram: int | None = None, hot: int = 8192) -> DataFrame:
    """id, n_bytes, spans (removed byte ranges) and kept (binary) for each row.

    Takes out every byte covered by a string of `length` bytes that also starts
    elsewhere in the corpus, the same text included; matches stay within texts.
    keep_first leaves the first such string, by id (nulls last), then order of
    rows, then place; without it all go. Rows that are equal in id and text are
    separate places. Null texts are empty. Other columns are not
    carried. hot bounds the contexts of an anchor in one task; what has more is
    split by longer anchors (see anchors.py).
    """
    units = Units(False, length, gram or max(1, length * 4 // 25))
    rows = stored(docs, id_col, text_col)
    spans = repeated_spans(rows, units, _check(keep_first), keep_first=keep_first, hot=hot, batch_bytes=1 << 21)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            texts, found = as_bytes(part.column(1)), [merged(s) for s in part.column(2).to_pylist()]
            ranges = pa.array([[{"start": a, "end": b} for a, b in s] for s in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            kept = pa.array([remove_spans(t, s) for t, s in zip(texts, found, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), ranges, kept], [id_col, "n_bytes", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return with_spans(rows, spans).mapInArrow(remove, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
