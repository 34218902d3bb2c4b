"""Each operator against a brute-force version on hostile small inputs, or an exact round trip."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillweave.llm import anchors, bpe, exact_dedup, mixing, perplexity_rules, phrase_dedup, quality_classifier, simhash_dedup, suffix_dedup, token_counts, warc
from rillweave.llm.queries import _removed, op5_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, rid string, fp double"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdeéñß", k=draw.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(draw.choices(vocabulary, k=n))
    shared, line = say(90), say(60)
    texts = [None, "", " \t\n", "one", "one two", "The  the THE", say(40), say(5000), "a" * 900, "ab" * 500, " ".join(["x"] * 200), "  wide space " * 30, "<|endoftext|> in <|endoftext|>text", "   lots   of\n\n\n  space  " * 20, "\x1c\x1d odd \x1e!\x1c separators", "日本語テキスト" * 80, "🙂" * 300]
    for i in range(40):
        texts.append(f"{say(draw.randint(0, 50))} {shared} {say(draw.randint(0, 50))}")
    base = say(120)
    for i in range(25):
        parts = base.split(" ")
        parts[i * 4] = "changed"
        texts.append(" ".join(parts))
    texts += [base, base, base.replace(" ", "\n\t"), f"{line}\n{say(3)}\n{line}\n\n{line}", *[say(60)] * 3]
    rows = [(i, t, draw.choice(["en", "fr", None]), draw.choice(["a", "b", None]), 0, "x", 7, None, 1.0) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, texts[25], "en", "a", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(docs, none):
    rows = [(r[0], hashlib.sha256(SPACE.sub(" ", r[1] or "").encode()).hexdigest()) for r in corpus()]
    size = Counter(h for _, h in rows)
    first = {}
    for i, h in rows:
        first[h] = min((x for x, g in rows if g == h and x is not None), default=None)
    got = collect(exact_dedup.exact_dedup(docs))
    assert Counter((r[0], r[1], r[2], r[4]) for r in got) == Counter((i, first[h], size[h], h) for i, h in rows)
    kept = Counter(r[4] for r in got if r[3])
    assert set(kept.values()) == {1} and len(kept) == len(size)
    assert all(r[0] == r[1] for r in got if r[3])
    assert collect(exact_dedup.exact_dedup(docs, filter_bits=1 << 16)) == got
    assert exact_dedup.shard_plan(100, 1 << 16, 4096) == (7, 1 << 16) and exact_dedup.shard_plan(10**9, 1 << 28, 16) == (60, 1 << 28)
    sharded = [tuple(r) for r in exact_dedup.exact_dedup(docs, filter_bits=1 << 16, bits_per_row=4096).collect()]
    assert sorted(sharded, key=repr) == got
    left = exact_dedup.keep_first_of_equal(docs)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in got if r[3])
    assert collect(exact_dedup.exact_dedup(none)) == []
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, filter_bits=1000)


def plain_fingerprint(text, size):
    words = [w.encode() for w in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, prints, distance):
    left, label = set(prints), {}
    while left:
        part, front = set(), [left.pop()]
        while front:
            x = front.pop()
            part.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            front += near
        least = min((i for i, p in zip(rows, prints, strict=True) if p in part and i is not None), default=None)
        label |= dict.fromkeys(part, least)
    return label


@pytest.mark.parametrize("size", [3, 5])
def test_simhash_groups(docs, none, size):
    rows = corpus()
    prints = [plain_fingerprint(r[1], size) for r in rows]
    label = plain_groups([r[0] for r in rows], prints, 3)
    want = sorted(((r[0], f"{p:016x}", label[p]) for r, p in zip(rows, prints, strict=True)), key=repr)
    assert collect(simhash_dedup.simhash_groups(docs, shingle=size)) == want
    assert collect(simhash_dedup.simhash_groups(none)) == []


@pytest.mark.parametrize("block", [3, 2048])
def test_simhash_links_of_dense_and_chained_prints(spark, block):
    draw = random.Random(9)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(40):  # a chain of steps of up to three bits, and a ball
            prints.add(centre)
            prints.add(centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
            for _ in range(3):
                centre ^= 1 << draw.randrange(64)
    for i in range(64):
        prints.add(1 << i)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    from rillweave.llm.components import connected_components

    got = connected_components(simhash_dedup.find_links(frame, 3, block)).collect()
    found = {r.node: r.component for r in got}
    label = plain_groups(list(range(len(prints))), prints, 3)
    mine = {}
    for p, s in zip(prints, signed, strict=True):
        mine.setdefault(found.get(s, s), set()).add(label[p])
    assert all(len(v) == 1 for v in mine.values()) and len(mine) == len(set(label.values()))


def test_pigeonring_prunes_no_link():
    draw = random.Random(1)
    for _ in range(3000):
        a = draw.getrandbits(64)
        b = a
        for i in draw.sample(range(64), draw.randint(0, 3)):
            b ^= 1 << i
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(simhash_dedup.linked(x, y, s, 3)[0] for s in range(4))


def near_copies(n=6):
    """Families of texts that differ in some words, ids from 0."""
    draw = random.Random(21)
    say = lambda k: ["".join(draw.choices("abcdefgh", k=5)) for _ in range(k)]
    out = []
    for family in range(n):
        base = say(300)
        for _ in range(12):
            own = list(base)
            for at in draw.sample(range(300), draw.randint(0, 2 * family)):
                own[at] = say(1)[0]
            out.append(" ".join(own))
    return out + [" ".join(say(200)) for _ in range(30)]


def test_pigeonring_prunes_no_wide_link():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, (4000, 4), np.uint64)
    b = a.copy()
    for i, n in enumerate(draw.integers(0, 60, 4000)):
        for bit in draw.choice(256, n, replace=False).tolist():
            b[i, bit // 64] ^= np.uint64(1 << (bit % 64))
    assert (simhash_dedup.wide_linked(a, b, 43) == (np.bitwise_count(a ^ b).sum(axis=1) <= 43)).all()


def shingle_set(text, size=5):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b, size=5):
    x, y = shingle_set(a, size), shingle_set(b, size)
    return len(x & y) / len(x | y) if x or y else 1.0


def plain_similar(ids, texts, similarity=0.8):
    """A number for each text's group, by comparing all pairs of shingle sets; the number is the place of the group's smallest id, nulls last."""
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    sets, label = [shingle_set(t) for t in texts], {i: i for i in order}
    for n, i in enumerate(order):
        for j in order[:n]:
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                old, new = sorted((label[i], label[j]), key=order.index, reverse=True)
                label = {k: new if v == old else v for k, v in label.items()}
    return [label[i] for i in range(len(texts))]


@pytest.mark.parametrize("block", [4, 1024])
def test_similar_groups(docs, none, spark, block):
    """Groups against all pairs, in families of one block and of many."""
    rows = corpus()
    texts = near_copies()
    for ids, texts, frame in (([r[0] for r in rows], [r[1] for r in rows], docs), (list(range(len(texts))), texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))):
        want = Counter(tuple(sorted(map(repr, g))) for g in groups_of(ids, plain_similar(ids, texts)))
        got = simhash_dedup.similar_groups(frame, block=block).collect()
        assert Counter(tuple(sorted(map(repr, g))) for g in groups_of([r.doc_id for r in got], [r.component for r in got])) == want
    assert collect(simhash_dedup.similar_groups(none)) == []
    with pytest.raises(ValueError):
        simhash_dedup.similar_groups(docs, similarity=0)


def groups_of(ids, labels):
    found = {}
    for i, x in zip(ids, labels, strict=True):
        found.setdefault(x, []).append(i)
    return found.values()


def test_large_families_in_blocks_lose_no_link(spark):
    """One family of chains whose ends differ: a set outside the largest cluster meets all blocks."""
    draw, texts = random.Random(41), []
    base = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(120)]
    for _ in range(3):
        own = list(base)
        for _ in range(40):
            own[draw.randrange(120)] = "".join(draw.choices("abcdefgh", k=6))
            texts.append(" ".join(own))
    got = simhash_dedup.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=7).collect()
    plain = plain_similar(list(range(len(texts))), texts)
    first = {}
    for r in sorted(got, key=lambda r: r.doc_id):
        first.setdefault(r.component, r.doc_id)
    assert {r.doc_id: first[r.component] for r in got} == dict(enumerate(plain))


def test_keep_one_of_each(docs):
    clash = docs.withColumn("PID", F.lit(1))
    got = simhash_dedup.keep_one_of_each(clash)
    assert got.columns == clash.columns
    rows = corpus()
    label = plain_similar([r[0] for r in rows], [r[1] for r in rows])
    kept = [r.doc_id for r in got.collect()]
    assert Counter(kept) == Counter(rows[i][0] for i in set(label))


def test_lone_pairs_at_the_similarity_are_found_and_others_stay(spark):
    """Pairs without other partners: 100 of a similarity just over 0.8, 100 just under it."""
    draw, texts = random.Random(31), []
    for pair in range(200):
        words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300)]
        other = list(words)
        for at in range(6 if pair < 100 else 7):
            other[20 + 40 * at] = "other"
        texts += [" ".join(words), " ".join(other)]
    assert all(0.8 <= jaccard(*texts[2 * i : 2 * i + 2]) < 0.82 if i < 100 else 0.78 < jaccard(*texts[2 * i : 2 * i + 2]) < 0.8 for i in range(200))
    got = {r.doc_id for r in simhash_dedup.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(2 * i + 1 not in got for i in range(100)) >= 97
    assert got >= {2 * i for i in range(200)} | set(range(200, 400))


def test_keep_one_of_shared_and_null_ids(spark):
    draw = random.Random(32)
    a, b, c = (["".join(draw.choices("abcdefgh", k=6)) for _ in range(200)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "other"])
    # Row 5 stands for its own group, but the row with its id is a near copy of row 1.
    rows = [(1, " ".join(a)), (5, " ".join(b)), (5, near(a)), (None, " ".join(c)), (None, " ".join(c)), (None, near(c))]
    got = simhash_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got if r.doc_id), key=repr) == sorted(rows[:2])
    assert len([r for r in got if r.doc_id is None]) == 1


def plain_spans(units, length):
    """units: a list of sequences; the covered places of each."""
    at = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        covered = set()
        for i in range(len(u) - length + 1):
            if at[tuple(u[i : i + length])] > 1:
                covered.update(range(i, i + length))
        out.append(covered)
    return out


@pytest.mark.parametrize("hot", [8192, 3])
@pytest.mark.parametrize("length", [200, 30])
def test_suffix_dedup_removes_all(docs, none, length, hot):
    rows = corpus()
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, c in zip(rows, texts, plain_spans(texts, length), strict=True):
        runs = sum(1 for i in c if i - 1 not in c)
        want.append((r[0], len(t), len(c), runs, bytes(x for i, x in enumerate(t) if i not in c)))
    found = suffix_dedup.suffix_dedup(docs, length=length, keep_first=False, hot=hot)
    got = [(r.doc_id, r.n_bytes, r.n, len(r.spans), bytes(r.kept)) for r in found.withColumn("n", _removed("spans")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert collect(suffix_dedup.suffix_dedup(none)) == []


def test_suffix_dedup_keeps_the_first(spark):
    draw = random.Random(5)
    say = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    shared = [say(150), say(80), say(300)]
    texts = [say(draw.randint(0, 90)) + draw.choice(shared)[draw.randint(0, 40) :] + say(draw.randint(0, 60)) for _ in range(40)]
    for hot in (8192, 2):
        found = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), length=50, hot=hot)
        got = {r.doc_id: bytes(r.kept).decode() for r in found.collect()}
        seen = set()
        for i, t in enumerate(texts):
            covered = set()
            for a in range(len(t) - 49):
                if t[a : a + 50] in seen:
                    covered.update(range(a, a + 50))
                seen.add(t[a : a + 50])
            assert got[i] == "".join(c for j, c in enumerate(t) if j not in covered)


def test_equal_rows_and_null_ids_are_separate_places(spark):
    draw = random.Random(15)
    say = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    text, other = say(300), say(300)
    frame = spark.createDataFrame([(None, text), (7, text), (7, text), (None, other), (None, say(250))], "doc_id long, text string").coalesce(1)
    kept = Counter((r.doc_id, len(r.kept)) for r in suffix_dedup.suffix_dedup(frame).collect())
    assert kept == Counter({(None, 0): 1, (7, 300): 1, (7, 0): 1, (None, 300): 1, (None, 250): 1})
    gone = Counter((r.doc_id, len(r.kept)) for r in suffix_dedup.suffix_dedup(frame, keep_first=False).collect())
    assert gone == Counter({(None, 0): 1, (7, 0): 2, (None, 300): 1, (None, 250): 1})


def marked(rows, size):
    """found_again over (a, c, salt, ...) rows in batches of a size."""
    names = ["a", "c", "id", "rid", "at", "salt"]
    table = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
    return [(r["a"], r["c"], r["rid"], r["m"]) for b in anchors.found_again(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]


def test_rows_of_repeated_anchors_are_found_as_a_stream():
    draw = random.Random(6)
    for size in (1, 2, 3, 7, 100):
        rows = sorted((draw.randint(0, 30), draw.randint(0, 2), 0, i, 0, draw.choice([0, 0, 5])) for i in range(60))
        rows = [(a, c, i, r, at, 5 if a % 5 == 0 else 0) for a, c, i, r, at, _ in rows]
        times, seen, want = Counter(r[0] for r in rows), Counter(), []
        for a, c, _, rid, _, salt in rows:
            seen[a, c] += 1
            if times[a] > 1 or salt:
                want.append((a, c, rid, int(seen[a, c] <= 2)))
        assert marked(rows, size) == want
    assert marked([], 5) == []


def test_an_anchor_of_a_million_runs_is_not_held():
    n, size = 1_000_000, 10_000

    def batches():
        for at in range(0, n, size):
            rows = np.arange(at, at + size)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int64)), *(pa.array(rows // 3 if c == "c" else rows) for c in ("c", "id", "rid", "at")), pa.array(np.zeros(size, np.int64))], ["a", "c", "id", "rid", "at", "salt"])

    import tracemalloc

    before = pa.total_allocated_bytes()
    tracemalloc.start()
    most, kept, firsts = 0, 0, 0
    for b in anchors.found_again(batches()):
        kept, firsts = kept + b.num_rows, firsts + sum(b.column(5).to_pylist())
        most = max(most, pa.total_allocated_bytes() - before + tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert kept == n and firsts == sum(2 if i < n // 3 else n % 3 for i in range(n // 3 + 1)) and most < 64 << 20


def test_a_digest_found_twice_decides_nothing():
    """Contexts that share a digest but not their content: suffix order and automata leave them alone; equal ones go."""
    draw = random.Random(9)
    say = lambda n: " ".join("".join(draw.choices("abcdef", k=4)) for _ in range(n)).encode()
    one, two = say(60), say(60)
    for content, other, goes in ((one, two, False), (one, None, False), (one, one, True)):
        spans = list(phrase_dedup._check([[[content, 26, 3, other]], [[say(50), 16, 0, None]]], anchors.Units(True, 35, 8)))
        assert ({i for i, *_ in spans}, bool(spans)) == ({0} if goes else set(), goes)
        for keep_first in (False, True):
            spans = list(suffix_dedup._check(keep_first)([[[content, len(content) - 199, 3, other]]], anchors.Units(False, 200, 32)))
            assert spans == ([(0, 0, len(content), True if keep_first else None)] if goes else [])
    # Parts that are equal count, whatever the rest: the second context's other place repeats a window of the first.
    near = one[:-4] + b"zzzz"
    assert list(suffix_dedup._check(False)([[[one, len(one) - 199, 3, near]]], anchors.Units(False, 200, 32))) == [(0, 0, len(one) - 4, None)]


def test_crowded_anchors_go_through_the_check(spark, monkeypatch):
    """Many texts around one common line: its anchors are split by longer ones, and with a check that finds nothing nothing goes."""
    draw = random.Random(14)
    say = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    line, twice = say(170), [say(40) for _ in range(4)]
    texts = [draw.choice(twice)[draw.randint(0, 30) :] + line + draw.choice(twice)[: draw.randint(0, 40)] + say(60) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(c) for i, c in enumerate(plain_spans([t.encode() for t in texts], 200))}
    assert sum(want.values()) > 2000
    for hot in (8192, 6):
        got = {r.doc_id: r.n for r in suffix_dedup.suffix_dedup(frame, keep_first=False, hot=hot).withColumn("n", _removed("spans")).collect()}
        assert got == want
    nothing = lambda groups, units: iter(())
    nothing.__module__ = "__main__"  # workers get it by value
    monkeypatch.setattr(suffix_dedup, "_check", lambda keep_first: nothing)
    assert all(not r.spans for r in suffix_dedup.suffix_dedup(frame, keep_first=False, hot=6).collect())


def test_split_runs_cover_their_windows():
    draw = random.Random(3)
    for _ in range(500):
        window, gram = draw.randint(1, 60), 1
        gram = draw.randint(1, window)
        place = draw.randint(0, 80)
        first = draw.randint(max(0, place + gram - window), place)
        n = draw.randint(1, place - first + 1)
        todo, seen = [(first, n, (place, place + gram))], []
        for _ in range(12):
            after = []
            for at, count, (lo, hi) in todo:
                assert all(s <= lo and hi <= s + window for s in range(at, at + count))
                if hi - lo == window:
                    assert count == 1
                    seen.append(at)
                    continue
                after += [(at + a, c, (at + a + x, at + a + y)) for a, c, (x, y) in anchors.split_run(count, (lo - at, hi - at), window)]
            todo = after
        assert not todo and sorted(seen) == list(range(first, first + n))


def test_previous_smaller():
    draw = random.Random(6)
    for values in [draw.choices(range(60), k=draw.randint(0, 60)) for _ in range(60)] + [[*range(1, 300), 0], list(range(300, 0, -1))]:
        got = suffix_dedup._previous_smaller(np.array(values, np.int64))
        assert got.tolist() == [next((j for j in range(i - 1, -1, -1) if values[j] <= x), -1) for i, x in enumerate(values)]


def test_aligned_suffixes_and_factors():
    """Orders, common prefixes and factors of random strings in groups, against plain slices."""
    draw = random.Random(2)
    for _ in range(60):
        depth, gram, strings, group, align = draw.randint(2, 9), "xy", [], [], []
        for g in range(draw.randint(1, 3)):
            for _ in range(draw.randint(1, 7)):
                left, right = ("".join(draw.choices("ab", k=draw.randint(0, 8))) for _ in range(2))
                strings.append(f"{left}{gram}{right}".encode())
                group.append(g)
                align.append(len(left))
        padded = lambda i, c: bytes(strings[i][align[i] + k] if 0 <= align[i] + k < len(strings[i]) else 0 for k in range(c, 20))
        for column, order, common in suffix_dedup.AlignedSuffixes(strings, np.array(group), np.array(align), depth).orders():
            assert order.tolist() == sorted(range(len(strings)), key=lambda i: (group[i], padded(i, column))) or sorted((group[i], padded(i, column)) for i in range(len(strings))) == [(group[i], padded(i, column)) for i in order]
            for a, b, n in zip(order, order[1:], common[1:], strict=False):
                x, y = padded(a, column), padded(b, column)
                lcp = next((k for k in range(len(x)) if x[k] != y[k]), len(x)) if group[a] == group[b] else 0
                assert min(n, depth) == min(lcp, depth)
        count = np.array([max(0, len(x) - depth + 1) for x in strings])
        for later in (False, True):
            got = suffix_dedup.factors_of_depth(strings, np.array(group), np.array(align), np.zeros(len(strings), np.int64), count, depth, later)
            for i, p, found in zip(*got, strict=True):
                others = [j for j in range(len(strings)) if group[j] == group[i] and (j < i or later and j > i) and 0 <= p - align[i] + align[j] < count[j]]
                assert found == any(strings[j][p - align[i] + align[j] :][:depth] == strings[i][p : p + depth] for j in others)
            assert len(got[0]) == count.sum()


@pytest.mark.parametrize("hot", [8192, 3])
@pytest.mark.parametrize("window", [35, 6])
def test_phrase_dedup(docs, none, window, hot):
    rows = corpus()
    words = [words_of(r[1]) for r in rows]
    want = [(r[0], len(w), len(c), " ".join(x for i, x in enumerate(w) if i not in c)) for r, w, c in zip(rows, words, plain_spans(words, window), strict=True)]
    found = phrase_dedup.phrase_dedup(docs, window=window, hot=hot)
    got = [(r.doc_id, r.n_words, r.n, r.kept) for r in found.withColumn("n", _removed("spans")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert collect(phrase_dedup.phrase_dedup(none)) == []


def test_bpe_round_trip(docs, none):
    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in corpus()), key=repr)
    for long_text in (1 << 16, 16):
        coded = bpe.bpe_encode(docs, file, pattern, long_text=long_text)
        got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.bpe_decode(coded, file, pattern).collect()]
        assert sorted(got, key=repr) == want
        both = bpe.bpe_encode(docs, file, pattern, long_text=long_text, round_trip=True)
        assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in both.collect()), key=repr) == want
    assert bpe.bpe_decode(bpe.bpe_encode(none, file, pattern), file, pattern).collect() == []


def test_cuts_are_refused_where_punctuation_takes_line_feeds():
    assert bpe.cuts_are_safe(public_tokenizers.PATTERN)
    greedy = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
    assert not bpe.cuts_are_safe(greedy)
    ranks = {bytes([x]): x for x in range(256)} | {b".\n": 256}
    enc = tiktoken.Encoding("greedy", pat_str=greedy, mergeable_ranks=ranks, special_tokens={})
    text = "word.\n" * 40
    assert bpe.encode_text(enc, text, 8) == enc.encode_ordinary(text)


def test_token_counts(docs, none):
    file = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(file)
    want = sorted(((r[0], len((r[1] or "").encode()), len(plain.encode(r[1] or "", add_special_tokens=False))) for r in corpus()), key=repr)
    assert collect(token_counts.token_counts(docs, file)) == want
    assert collect(token_counts.token_counts(docs, file, table_size=5, sample_rows=3, cache_bytes=2000)) == want
    assert collect(token_counts.token_counts(none, file)) == []
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_warc_round_trip(spark, tmp_path):
    body = "<p>é</p>" * 30
    rows = [(3, "http://a/b c\r\nX: y", body), (1, None, body), (2, "u", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", body), (None, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 200), (8, "u", "\x1f\x8b\x08" * 60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=1000)
    got = warc.read_warc(spark, f"file://{tmp_path}/w").withColumn("page", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    assert not [r for r in got if r.gap]
    want = Counter()
    for i, _, html in rows:
        again = html == body and i != 1
        want[i, "revisit" if again else "response", 1 if again else None, len((html or "").encode()), None if again else (html or "").encode()] += 1
    assert Counter((r.page, r.warc_type, r.to, r.payload_length, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert {r.payload_digest for r in got if r.page in (1, 2, 3)} == {"sha256:" + hashlib.sha256(body.encode()).hexdigest()}
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    assert whole.startswith(b"WARC/1.1") and whole.count(b"WARC-Type: ") == len(rows) + 1  # one is inside a payload


def test_warc_files_end_by_bytes(spark, tmp_path):
    """Archives stay near their size whatever the records': many small ones, some long, one longer than a file."""
    draw = random.Random(2)
    say = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    rows = [(i, "u", say(100_000 if i % 4 else 900)) for i in range(60)] + [(60, "u", say(3_000_000)), (61, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=1 << 20)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert sum(s > (1 << 20) + 110_000 for s in sizes) == 1 and sizes[-1] < 4_000_000 and len(sizes) >= 4
    got = warc.read_warc(spark, f"file://{tmp_path}/w").withColumn("page", warc.page_of("record_id")).collect()
    assert not [r for r in got if r.gap] and {r.page: bytes(r.payload).decode() for r in got} == {i: h for i, _, h in rows}


@pytest.mark.parametrize("packed", [False, True])
def test_warc_salvage(packed):
    record = lambda i: (warc.gzip_member if packed else bytes)(warc.build_record(i, f"http://x/{i}", f"payload {i} ".encode() * 40))
    parts = [record(i) for i in range(8)]
    whole = b"".join(parts)
    ids = lambda data: [x.headers["warc-record-id"][-2:-1] for x in warc.read_archive(data) if isinstance(x, warc.Record)]
    gaps = lambda data: [(x.offset, x.length) for x in warc.read_archive(data) if isinstance(x, warc.Gap)]
    assert ids(whole) == list("01234567") and gaps(whole) == []
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    broken = bytearray(whole)
    broken[starts[2] + len(parts[2]) // 2] ^= 0x5A
    assert ids(bytes(broken)) == list("0134567") and gaps(bytes(broken)) == [(starts[2], len(parts[2]))]
    junk = b"WARC/1.1\r\nnoise \x1f\x8b\x08 more"
    noise = whole[: starts[3]] + junk + whole[starts[3] :]
    assert ids(noise) == list("01234567") and gaps(noise) == [(starts[3], len(junk))]
    cut = whole[: starts[5] + 20]
    assert ids(cut) == list("01234") and gaps(cut) == [(starts[5], 20)]
    missing = whole[: starts[1] + 30] + whole[starts[4] :]
    assert ids(missing) == list("04567") and gaps(missing) == [(starts[1], 30)]
    assert list(warc.read_archive(b"")) == []
    assert gaps(b"nothing here") == [(0, 12)]


def test_warc_salvage_inside_members():
    """A member of eight records: one damaged; cut off; flipped. And headers that are no headers."""
    block = lambda i: warc.build_record(i, f"http://x/{i}", random.Random(i).randbytes(3000))
    parts = [block(i) for i in range(8)]
    ids = lambda found: [x.headers["warc-record-id"][-2:-1] for x in found if isinstance(x, warc.Record)]
    bad = bytearray(parts[3])
    bad[-100] ^= 1
    content = b"".join([*parts[:3], bytes(bad), *parts[4:]])
    found = list(warc.read_archive(warc.gzip_member(content)))
    assert ids(found) == list("0124567")
    assert [(x.inner, x.length) for x in found if isinstance(x, warc.Gap)] == [(sum(map(len, parts[:3])), len(parts[3]))]
    member = warc.gzip_member(b"".join(parts))
    found = list(warc.read_archive(member[: len(member) * 9 // 10] + warc.gzip_member(parts[0])))
    assert ids(found) == list("01234560") and [(x.offset, x.length) for x in found if isinstance(x, warc.Gap) and x.inner is None] == [(0, len(member) * 9 // 10)]
    flipped = bytearray(member)
    flipped[len(member) // 2] ^= 0x10
    found = list(warc.read_archive(bytes(flipped)))
    assert ids(found)[:3] == list("012") and any(isinstance(x, warc.Gap) and x.inner is None for x in found)
    folded = parts[1].replace(b"WARC-Target-URI: http", b"WARC-Target-URI:\r\n http")
    assert [x.headers["warc-target-uri"].strip() for x in warc.read_archive(folded)] == ["http://x/1"]
    huge = parts[1].replace(b"WARC-Type", b"X: 1\r\nContent-Length: " + b"9" * 5000 + b"\r\nWARC-Type", 1)
    odd = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\nHTTP", parts[2])
    assert ids(warc.read_archive(huge + odd + parts[4])) == ["1", "4"]
    http = b"HTTP/1.1 200 OK\r\nno colon here\r\nContent-Length: " + b"7" * 5000 + b"\r\n\r\nbody"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    assert [x.payload()[0] for x in warc.read_archive(record)] == [b"body"]


@pytest.mark.parametrize("seed", range(40))
def test_warc_fuzz(seed):
    """Flips, cuts, lost stretches and noise: no crash; each record left whole and not in a damaged member comes back, none is made up, and outer gaps and records cover the archive."""
    draw = random.Random(seed)
    parts = [warc.build_record(i, f"http://x/{i}", draw.randbytes(draw.randint(0, 500)) + b"text " * draw.randint(0, 300), draw.choice([None, None, 3])) for i in range(12)]
    groups, at = [], 0
    while at < 12:
        n = draw.randint(1, 4)
        groups.append((parts[at : at + n], draw.random() < 0.7))
        at += n
    pieces = [warc.gzip_member(b"".join(g)) if packed else b"".join(g) for g, packed in groups]
    hit = draw.randrange(len(pieces))
    damaged = bytearray(pieces[hit])
    for _ in range(draw.randint(1, 3)):
        kind, place = draw.randrange(4), draw.randrange(max(1, len(damaged)))
        if kind == 0 and damaged:
            damaged[place] ^= 1 << draw.randrange(8)
        elif kind == 1:
            del damaged[place:]
        elif kind == 2:
            del damaged[place : place + draw.randint(1, 300)]
        else:
            damaged[place:place] = draw.choice([b"\x1f\x8b\x08", b"WARC/1.0\r\n", draw.randbytes(40)])
    pieces[hit] = bytes(damaged)
    data = b"".join(pieces)
    found = list(warc.read_archive(data))
    blocks = Counter(x.block for x in found if isinstance(x, warc.Record))
    blocks_of = lambda g: [p[p.index(b"\r\n\r\n") + 4 : -4] for p in g]
    whole = Counter(b for i, (g, _) in enumerate(groups) if i != hit for b in blocks_of(g))
    last = hit + 1 < len(groups) and not groups[hit][1] and not groups[hit + 1][1]  # a plain record whose end is lost may take bytes of its plain neighbour along
    if not last:
        assert not whole - blocks
    told = {x.block for x in found if isinstance(x, warc.Record) and x.headers.get("warc-block-digest", "").startswith("sha256:")}
    assert told <= {b for g, _ in groups for b in blocks_of(g)}
    spans = sorted({(x.offset, x.length) for x in found if x.inner is None or isinstance(x, warc.Record)})
    covered = sum(n for _, n in spans)
    assert covered >= len(data) - 40 or any(isinstance(x, warc.Gap) for x in found)


def test_warc_text_ids_and_gap_log(spark, tmp_path):
    rows = [("a b/ü", "u", "x" * 200), ("c>d%41+", "u", "x" * 200), (None, "u", "short")]
    warc.write_warc(spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    part = next((tmp_path / "w").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"noise")
    (tmp_path / "w" / f".{part.name}.crc").unlink(missing_ok=True)
    found = warc.read_warc(spark, f"file://{tmp_path}/w")
    got = {r.page: (r.warc_type, r.to) for r in found.where("gap is null").select("warc_type", warc.page_of("record_id", "STRING").alias("page"), warc.page_of("refers_to", "STRING").alias("to")).collect()}
    assert got == {"a b/ü": ("response", None), "c>d%41+": ("revisit", "a b/ü"), None: ("response", None)}
    warc.log_gaps(found, f"file://{tmp_path}/gaps")
    assert [(r.length, r.gap) for r in spark.read.json(f"file://{tmp_path}/gaps").collect()] == [(5, "no version line")]


def test_warc_reads_long_headers_and_op5_fails_on_gaps(spark, tmp_path, monkeypatch):
    long = warc.build_record(1, "data:" + "x" * 200_000, b"payload")
    parts = [warc.gzip_member(long), long, warc.gzip_member(warc.build_record(2, "u", b"other"))]
    assert [x.headers["warc-record-id"][-2:-1] for x in warc.read_archive(b"".join(parts))] == ["1", "1", "2"]
    spark.createDataFrame([(1, "data:" + "x" * 70_000, "a" * 200), (2, "u", "a" * 200)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in op5_warc(spark, str(tmp_path)).collect()) == [(1, "response", None), (2, "revisit", 1)]
    monkeypatch.setattr("rillweave.llm.queries.write_warc", lambda pages, path: pages.limit(1).selectExpr("'noise' AS value").write.text(path))
    with pytest.raises(Exception, match="gap in a written archive"):
        op5_warc(spark, str(tmp_path)).collect()


def test_mixing(docs, none):
    assert mixing.mix_sources(none).collect() == []
    got = mixing.mix_sources(docs, seed=4)
    assert got.columns == [*docs.columns, "copy_no", "n_copies", "shuffle_key"]
    assert collect(got) == collect(mixing.mix_sources(docs.repartition(2), seed=4))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "ab", "s", 0.5, i, 2.0, "m", 1, 2, 3) for i in range(30)], "doc_id long, text string, source string, rate double, k long, CDF double, mix_source string, copy_no int, n_copies int, bytes int")
    got = mixing.mix_sources(docs, {"s": 1.0}, total_bytes=240)
    assert got.columns == ["doc_id", "text", "source", "rate", "k", "CDF", "mix_source", "bytes", "copy_no", "n_copies", "shuffle_key"]
    assert 60 < got.count() < 180 and {r.rate for r in got.collect()} == {0.5}


def test_mixing_meets_its_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise("cold").alias("source"), F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int")).alias("text"))
    size = F.sum(F.octet_length("text"))
    total = docs.agg(size).first()[0]
    share = {r.source: r[1] / total for r in mixing.mix_sources(docs, {"hot": 3.0, "cold": 1.0}).groupBy("source").agg(size).collect()}
    assert set(share) == {"hot", "cold"} and abs(share["hot"] - 0.75) < 0.02 and abs(share["cold"] - 0.25) < 0.02
    copies = [r.n_copies for r in mixing.mix_sources(docs, {"hot": 1.0}, total_bytes=6 * total / 3).where("copy_no = 1").select("n_copies").collect()]
    assert abs(np.mean(copies) * len(copies) / 6667 - 6) < 0.15  # Poisson of mean and variance 6
    big = mixing.mix_sources(docs.limit(50), {"hot": 1.0, "cold": 1.0}, total_bytes=2e6)
    assert abs(big.agg(size).first()[0] / 2e6 - 1) < 0.1


def plain_kneser_ney(grams, order):
    """Interpolated modified Kneser-Ney from its definition, by dictionaries; grams: tuples of symbols."""
    tables = {order: Counter(grams)}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cuts = {}
    for n, t in tables.items():
        seen = Counter(t.values())
        y = seen[1] / max(1, seen[1] + 2 * seen[2])
        cuts[n] = [0, *(min(max(i - (i + 1) * y * seen[i + 1] / seen[i], 0), i) if seen[i] else i / 2 for i in (1, 2, 3))]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        same = [c for x, c in tables[n].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        c = tables[n][g]
        return (c - cuts[n][min(c, 3)] + sum(cuts[n][min(x, 3)] for x in same) * p(g[1:])) / sum(same)

    return p


def padded_grams(text, order):
    body = " " * (order - 1) + " ".join(words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    data = body.encode()
    return [tuple(data[i : i + order]) for i in range(len(data) - order + 1)]


def unpacked(g, order):
    return tuple(g >> (8 * (order - 1 - k)) & 255 for k in range(order))


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_by_definition(spark, order):
    texts = ["the cat sat on the mat", "a  CAT and a rat", "", "thethethe a", "é x"]
    rows = spark.createDataFrame([(t, "x" if i % 2 else None) for i, t in enumerate(texts * 2)], "text string, lang string").repartition(3).select(F.spark_partition_id().alias("pid"), "lang", "text")
    counts = perplexity_rules.count_ngrams(perplexity_rules.part_ngrams(rows, order))
    got = {(r.lang, unpacked(r.g, order)): r.p for r in perplexity_rules.kneser_ney(counts, order).collect()}
    want = {}
    for lang in (None, "x"):
        grams = [g for i, t in enumerate(texts * 2) if (lang == "x") == bool(i % 2) for g in padded_grams(t, order)]
        p = plain_kneser_ney(grams, order)
        want |= {(perplexity_rules.language_number(lang), g): p(g) for g in grams}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_parts_follow_from_rows_and_not_from_batches(monkeypatch):
    monkeypatch.setattr(perplexity_rules, "_PART", 50)
    draw = random.Random(1)
    texts = ["x" * draw.randint(0, 40) for _ in range(400)] + ["y" * 500, "z"]
    table = pa.table({"pid": pa.array([3] * len(texts), pa.int32()), "text": texts})
    seen = []
    for size in (1, 7, 256, 1000):
        parts = [(number, body) for number, batch, bodies in perplexity_rules._in_parts(iter(table.to_batches(max_chunksize=size))) for body, _ in zip(bodies, batch.to_pylist(), strict=True)]
        assert [b.decode() for _, b in parts] == texts
        seen.append([n for n, _ in parts])
    assert all(s == seen[0] for s in seen) and len(set(seen[0])) > 50 and seen[0] == sorted(seen[0])


def cached(f):
    held = {}
    return lambda g: held[g] if g in held else held.setdefault(g, f(g))


def plain_base(text):
    text = text or ""
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if words_of(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_quality_rules(docs, none):
    got = perplexity_rules.quality_rules(docs).collect()
    base = Counter()
    for r in corpus():
        b = plain_base(r[1])
        base[(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == base
    assert not any(r.kept and r.base_failed for r in got)
    # Every score and verdict, from the definitions.
    scores = {}
    for lang in {r[2] for r in corpus()}:
        own = [r[1] for r in corpus() if r[2] == lang]
        p = cached(plain_kneser_ney([g for t in own for g in padded_grams(t, 5)], 5))
        scores |= {(lang, t): -np.mean([np.log(p(g)) for g in grams]) for t in own if (grams := padded_grams(t, 5))}
    ranges = {}
    for lang in {r[2] for r in corpus()}:
        bins = sorted(round(scores[lang, r[1]] * 10_000) for r in corpus() if r[2] == lang and (b := plain_base(r[1]))[0] >= 50 and 100 * b[4] <= 50 * b[0])
        q1, q3 = (bins[math.ceil(share * len(bins)) - 1] for share in (0.25, 0.75)) if bins else (0, 0)
        ranges[lang] = q1 - 2 * max(q3 - q1, 100), q3 + 2 * max(q3 - q1, 100)
    want = Counter()
    for r in corpus():
        b, x = plain_base(r[1]), scores.get((r[2], r[1]))
        low, high = ranges[r[2]]
        good = not (b[0] < 50 or 100 * b[4] > 50 * b[0]) and low <= round(x * 10_000) <= high
        want[r[0], good, None if x is None else round(x, 3)] += 1
    assert Counter((r.doc_id, r.kept, None if r.log_perplexity is None else round(r.log_perplexity, 3)) for r in got) == want
    assert perplexity_rules.quality_rules(none).collect() == []


def test_perplexity_bands_reject_strange_text(spark):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choices("aeiou", k=2)) + "".join(draw.choices("nrst", k=2)) for _ in range(60)]
    rows = [(i, " ".join(draw.choices(vocabulary, k=100)), ["x", "y"][i % 2]) for i in range(200)]
    rows += [(500, " ".join("".join(draw.choices("qzxjkv#%", k=6)) for _ in range(100)), "x"), (501, " ".join(draw.sample([f"aa{'a' * (i % 9)}" for i in range(9000)], 200)), "y")]
    got = {r.doc_id: r for r in perplexity_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[500].kept and all(got[i].kept for i in range(200))


def test_perplexity_bands_reject_planted_junk(spark):
    """Of rows with common and rare words: those with junk in them leave by the upper band, one of common words only by the lower."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefghijklmnoprstu", k=draw.randint(3, 9))) for _ in range(400)]
    say = lambda k: draw.choices(vocabulary, [1 / (i + 1) for i in range(400)], k=k)
    junk = lambda words, share: " ".join(w[:4] + draw.choice(["###", "$$$", "%%%"]) if draw.random() < share else w for w in words)
    rows = [(i, " ".join(say(150)), "x") for i in range(300)] + [(1000 + i, junk(say(150), 0.3), "x") for i in range(5)]
    rows += [(2000, " ".join(draw.choices(vocabulary[:12], k=150)), "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity_rules.quality_rules(frame).collect()}
    middle = np.median([r.log_perplexity for r in got.values()])
    assert not any(r.base_failed for r in got.values())
    assert not got[2000].kept and got[2000].log_perplexity < middle
    assert all(not got[1000 + i].kept and got[1000 + i].log_perplexity > middle for i in range(5))
    assert sum(got[i].kept for i in range(300)) >= 294
    wide = {r.doc_id: r.kept for r in perplexity_rules.quality_rules(frame, fence=30.0).collect()}
    assert any(wide[1000 + i] for i in range(5))


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    # Labels that are held out have no part in the scores.
    other = labels.withColumn("quality", F.when(quality_classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, other).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in scored)


def test_word_vectors_and_pools_by_definition(spark):
    """Context sums over dictionaries, pools over lists; tasks and runs don't change them."""
    space = quality_classifier.Space(buckets=32, dim=8)
    texts = [r[1] for r in corpus()][:40]
    places, signs = space.index()
    want = np.zeros((32, 8))
    for t in texts:
        ids = [zlib.crc32(w.encode()) % 32 for w in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        for i, a in enumerate(ids):
            for far in (-2, -1, 1, 2):
                if 0 <= i + far < len(ids):
                    for k in range(quality_classifier.NONZERO):
                        want[a, (places[ids[i + far], k] + far) % 8] += signs[ids[i + far], k]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sums = quality_classifier.context_sums(frame, "text", space)
    assert np.array_equal(sums, want)
    vectors = quality_classifier.word_vectors(sums, space)
    for t in [*texts, "a b c d e f " * 30_000]:
        v = [vectors[zlib.crc32(w.encode()) % 32].astype(float) for w in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        n = max(1, len(v))
        mean, pairs = sum(v, np.zeros(8)) / n, sum((x * y for x, y in zip(v, v[1:], strict=False)), np.zeros(8)) / n
        spread = np.sqrt(np.maximum(sum((x * x for x in v), np.zeros(8)) / n - mean**2, 0))
        assert np.allclose(quality_classifier.pool((t or "").encode(), vectors), np.concatenate([mean, spread, pairs]), atol=1e-4)
    ids = spark.range(300).select(F.col("id"), quality_classifier.held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)


def test_classifier_sample_is_bounded_under_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 4 + 1, f"text {i} of some words") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, y, old=quality_classifier.fit: seen.append(len(x)) or old(x, y))
    quality_classifier.train(docs, labels, sample_rows=20)
    assert seen == [20]


def test_quality_classifier_edges(docs, none, spark):
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0), (20, 1), (21, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(none, labels).collect() == []
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
