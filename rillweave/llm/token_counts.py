"""Token counts by a map-side lookup in two tiers, with no shuffle of pre-tokens.

A text is split into pre-tokens by the splitter's own pattern, after its
special strings are set apart; its count is the sum over its pre-tokens. Tier
one is a compact hash table, broadcast: sorted 128-bit hashes of frequent
pre-tokens with their token counts, chosen from a bounded sample of texts. Tier
two is each worker's cache, bounded in bytes, which stays while the worker does,
for all its tasks: pre-tokens in neither are encoded by the library once and
kept. The sample and both tiers only save work: every pre-token of every text
is counted, and the counts are the library's. Only the stretch around a
character that may be newer than a Unicode table goes to the library unsplit.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: The published pattern of byte-level splitters.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points outside these ranges may be newer than one of the two Unicode tables, the library's and this module's.
_ODD = regex.compile(r"[^\x00-\u0557\u0590-\u088e\u0900-\u0c5b\u1e00-\u208e\u20a0-\ua7cd\uac00-\ud7a3\U0001f300-\U0001f64f]")
#: Stretches of a text: to between a line's letter or digit of ASCII and a space that another such follows, where a pre-token ends whatever stands elsewhere.
_STRETCH = regex.compile(r"(?s).{256,}?[A-Za-z0-9](?= [A-Za-z0-9])")
_CHUNK = 1 << 16
_LONGEST_KEPT = 256


def load_tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def special_pattern(definition: str) -> regex.Pattern | None:
    """Matches the strings that the library, as its default, takes from a text as one token; longest first."""
    found = sorted((t["content"] for t in json.loads(definition).get("added_tokens", [])), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, found))) if found else None


def check_supported(definition: str) -> None:
    """The pattern above is that of a plain byte-level splitter only."""
    d = json.loads(definition)
    split = d.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or d.get("normalizer"):
        raise ValueError("counting by pre-tokens needs a byte-level tokenizer without prefix space and normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in d.get("added_tokens", [])):
        raise ValueError("special tokens that take white space with them are not supported")


def _hashes(tokens: Iterable[str]) -> np.ndarray:
    """128-bit hashes as rows of two numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode()) for t in tokens), "<u8").reshape(-1, 2)


@dataclass(frozen=True)
class LengthTable:
    """Tier one: sorted hashes with token counts, 20 bytes an entry."""

    high: np.ndarray
    low: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: list[str], lengths: list[int]) -> LengthTable:
        hashes = _hashes(tokens)
        order = np.argsort(hashes[:, 0])
        return cls(hashes[order, 0], hashes[order, 1], np.array(lengths, np.uint32)[order])

    def find(self, tokens: list[str]) -> np.ndarray:
        """Their token counts; 0 for those that the table hasn't."""
        if not len(self.high) or not tokens:
            return np.zeros(len(tokens), np.uint32)
        hashes = _hashes(tokens)
        at = np.minimum(np.searchsorted(self.high, hashes[:, 0]), len(self.high) - 1)
        return np.where((self.high[at] == hashes[:, 0]) & (self.low[at] == hashes[:, 1]), self.lengths[at], 0)


class TokenCounter:
    """Counts tokens of texts; holds tier one and a tier two of two generations of at most cache_bytes together."""

    def __init__(self, definition: str, frequent: LengthTable, cache_bytes: int):
        self.tokenizer, self.special, self.frequent = load_tokenizer(definition), special_pattern(definition), frequent
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size, self.limit = 0, cache_bytes // 2

    def _encoded(self, tokens: list[str]) -> Iterator[int]:
        for at in range(0, len(tokens), 4096):
            yield from map(len, self.tokenizer.encode_batch(tokens[at : at + 4096], add_special_tokens=False))

    def _keep(self, token: str, n: int) -> None:
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[token] = n
        self.size += 120 + 2 * len(token)

    def _chunk(self, tokens: list[str]) -> int:
        """tokens: at most _CHUNK of them."""
        missing = [t for t in set(tokens).difference(self.young)]
        if not missing:
            return sum(map(self.young.__getitem__, tokens))
        times, total = Counter(tokens), 0
        for t in times.keys() & self.young.keys():
            total += times[t] * self.young[t]
        unknown = [t for t in missing if t not in self.old]
        found = dict(zip(unknown, self.frequent.find(unknown).tolist(), strict=True))
        rare = [t for t, n in found.items() if not n]
        found.update(zip(rare, self._encoded(rare), strict=True))
        found.update((t, self.old[t]) for t in missing if t in self.old)
        for t, n in found.items():
            total += times[t] * n
            if len(t) <= _LONGEST_KEPT:
                self._keep(t, n)
        return total

    def _segment(self, text: str) -> int:
        if len(text) <= 4 * _CHUNK:
            found = PRE_TOKEN.findall(text)
            return sum(self._chunk(found[at : at + _CHUNK]) for at in range(0, len(found), _CHUNK))
        matches, total = (m.group() for m in PRE_TOKEN.finditer(text)), 0
        while part := list(islice(matches, _CHUNK)):
            total += self._chunk(part)
        return total

    def _plain(self, text: str) -> int:
        """A text without special strings: its stretches with odd characters by the library, what is between by pre-tokens."""
        if not _ODD.search(text):
            return self._segment(text)
        total, at, begin = 0, 0, 0  # the stretches from begin to at have no odd characters
        while at < len(text):
            found = _STRETCH.match(text, at)
            end = found.end() if found else len(text)
            if _ODD.search(text, at, end):
                total += self._segment(text[begin:at]) + len(self.tokenizer.encode(text[at:end], add_special_tokens=False))
                begin = end
            at = end
        return total + self._segment(text[begin:])

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))


#: The counter of this process, with what it is for: tier two outlives tasks.
_own: tuple[object, TokenCounter] | None = None


def worker_counter(definition: str, frequent: LengthTable, cache_bytes: int) -> TokenCounter:
    """This worker's counter for a tokenizer; another one takes its place if the tokenizer or the bound changes. Tier one may change without loss."""
    global _own
    key = (xxhash.xxh3_128_digest(definition.encode()), cache_bytes)
    if _own is None or _own[0] != key:
        _own = (key, TokenCounter(definition, frequent, cache_bytes))
    _own[1].frequent = frequent
    return _own[1]


def frequent_lengths(docs: DataFrame, definition: str, text_col: str, *, table_size: int, sample_rows: int, longest: int = 1 << 16) -> LengthTable:
    """Tier one: the most frequent pre-tokens of at most sample_rows texts of at most `longest` bytes each, which the driver reads without an exchange."""
    text = F.col(f"`{text_col}`").cast("string")
    sample = docs.where(F.octet_length(text) <= longest).select(text.alias("text")).take(sample_rows)
    special, seen = special_pattern(definition), Counter()
    for (t,) in sample:
        seen.update(PRE_TOKEN.findall(special.sub(" ", t) if special else t))
    tokens = [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size]]
    tokenizer = load_tokenizer(definition)
    return LengthTable.of(tokens, [len(x) for x in tokenizer.encode_batch(tokens, add_special_tokens=False)])


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", *, table_size: int = 1 << 15, sample_rows: int = 1024, cache_bytes: int = 128 << 20) -> DataFrame:
    """id, n_bytes and n_tokens for each row; null counts as empty. Other columns are not carried.

    table_size bounds tier one, cache_bytes each worker's tier two, sample_rows
    the texts that the choice of tier one looks at. Rows are counted each on
    its own, so repeated ids and rows are fine.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    check_supported(definition)
    table = frequent_lengths(docs, definition, text_col, table_size=table_size, sample_rows=sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((definition, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(*shared.value, cache_bytes)
        for batch in small(batches):
            n = [counter.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
