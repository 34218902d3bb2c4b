"""Neighbour search, Lloyd's rounds and source divergence against plain versions, over hostile rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest

from rillweave.llm import lloyd, projected_search, source_divergence
from rillweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row string, cell int, near double, id int, cluster int"
DOCS = "doc_id long, text string, lang string, source string, chunk int, place string, term int"


def with_rest(pairs):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "r", 2, 0.5, 3, 4) for i, v in pairs]


# Neighbours


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)


def plain_neighbours(pairs, asks, k):
    """For each query row (id, its k best as (score, id)), scores rounded."""
    rows = [(i, v) for i, v in pairs if good(v)]
    out = []
    for at, (i, v) in enumerate(rows):
        if asks(i):
            scores = [(-round(float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), 9), math.inf if j is None else j) for b, (j, w) in enumerate(rows) if b != at]
            out.append((i, sorted(scores)[:k]))
    return sorted(out, key=repr)


def found_neighbours(df):
    """The same of a result; rows that repeat a query's id come out as one list."""
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((-round(r.score, 9), math.inf if r.vec_id is None else r.vec_id, r.rank))
    return out


ODD = [(3, None), (5, []), (7, [0.0] * 6), (8, [1, 2, None, 4, 5, 6]), (9, [float("nan")] * 6), (11, [float("inf"), 1, 1, 1, 1, 1])]


def test_neighbours_are_exact_where_the_test_never_stops(spark):
    draw = np.random.default_rng(4)
    pairs = ODD + [(100 + i, draw.normal(size=6)) for i in range(300)]
    pairs += [(1000 + i, [1.0, 2, 3, 4, 5, 6]) for i in range(150)]  # a third of the rows are copies
    pairs += [(None, [1.0, 2, 3, 4, 5, 6]), (-20, [9.0, 0, 0, 0, 0, 0]), (2000, draw.normal(size=6) * 1e3)]
    df = spark.createDataFrame(with_rest(pairs), VECTORS).repartition(5)
    found = found_neighbours(projected_search.nearest_neighbours(df, k=7, confidence=1 - 1e-12, cell_rows=40, block_rows=30, leaf=8, step=2))
    want = plain_neighbours(pairs, lambda i: i is not None and i % 20 == 0, 7)
    assert {i for i, _ in want} == set(found) and -20 in found and 2000 in found
    for i, best in want:
        assert sorted(found[i]) == [(s, j, n + 1) for n, (s, j) in enumerate(best)]


def test_neighbours_stop_early_with_good_recall(spark, monkeypatch):
    draw = np.random.default_rng(5)
    homes = draw.normal(size=(40, 24)) * 12
    pairs = [(i, homes[i % 40] + draw.normal(size=24)) for i in range(2000)]
    df = spark.createDataFrame(with_rest(pairs), VECTORS).repartition(5)
    found = found_neighbours(projected_search.nearest_neighbours(df, k=10, cell_rows=100, block_rows=100, leaf=16, step=4))
    want = dict(plain_neighbours(pairs, lambda i: i % 20 == 0, 10))
    assert set(found) == set(want)
    hits = sum(len({j for _, j in want[i]} & {j for _, j, _ in found[i]}) for i in want)
    assert hits >= 0.9 * 10 * len(want)
    # The search leaves vectors alone here.
    x = np.array([v for _, v in pairs])
    mapping = projected_search.Projection.of(24, 8, float(np.linalg.norm(x, axis=1).max()), 23)
    block = projected_search.Block(np.arange(2000), np.arange(2000), np.zeros(2000, bool), x, mapping.candidates(x), 16)
    seen = Counter()

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen["rows"] += key.stop - key.start
            return np.asarray(super().__getitem__(key))

    block.x = block.x.view(Watched)
    for i in range(0, 200, 20):
        q = x[i : i + 1]
        list(block.search(np.array([i]), q, mapping.queries(q), np.array([-np.inf]), 10, mapping.longest, projected_search.chi_square_quantile(0.96, 8)))
    assert 0 < seen["rows"] < 0.7 * 10 * 2000


def test_neighbours_of_repeated_rows_and_few_rows(spark):
    pairs = [(20, [1.0, 0]), (20, [1.0, 0]), (40, [0.5, 0.5]), (41, [0, 2.0, 1.0])]
    got = projected_search.nearest_neighbours(spark.createDataFrame(with_rest(pairs), VECTORS))
    found = found_neighbours(got)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(found[20]) == sorted([(-1.0, 20, 1), (-0.5, 40, 2), (0.0, 41, 3)] * 2)  # each row asks for itself
    assert sorted(found[40]) == [(-1.0, 41, 1), (-0.5, 20, 2), (-0.5, 20, 3)]
    assert projected_search.nearest_neighbours(spark.createDataFrame(with_rest([(20, [1.0])]), VECTORS)).collect() == []
    assert projected_search.nearest_neighbours(spark.createDataFrame(with_rest(ODD), VECTORS)).collect() == []


def test_chi_square_quantile():
    # Published quantiles.
    assert abs(projected_search.chi_square_quantile(0.95, 2) - 5.991) < 1e-3
    assert abs(projected_search.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(projected_search.chi_square_quantile(0.99, 10) - 23.209) < 1e-3
    with pytest.raises(ValueError):
        projected_search.chi_square_quantile(0.9, 7)


def test_op11_recall(spark):
    table = ds.dataset(f"{SF}/embeddings.parquet").to_table()
    pairs = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    want = dict(plain_neighbours(pairs, lambda i: i % 20 == 0, 20))
    found = found_neighbours(QUERIES["op11_neighbours"](spark, SF))
    assert set(found) == set(want) and all([r for *_, r in sorted(v, key=lambda x: x[2])] == list(range(1, 21)) for v in found.values())
    assert sum(len({j for _, j in want[i]} & {j for _, j, _ in found[i]}) for i in want) >= 0.9 * 20 * len(want)


# Lloyd's rounds


def plain_lloyd(pairs, k, rounds, dim, scale=64):
    rows = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in pairs if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)[1]].append(v)
        cents = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in rows]
    by = Counter()
    for _, d, n in found:
        by[n] += d
    return Counter((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in found)


@pytest.mark.parametrize(("k", "block_rows"), [(5, 7), (16, 1024), (400, 64)])
def test_lloyd(spark, k, block_rows):
    draw = np.random.default_rng(6)
    pairs = ODD + [(i, draw.normal(size=6) + 3 * (i % 4)) for i in range(150)] + [(500 + i, [0.5] * 6) for i in range(60)]
    pairs += [(700 + i, draw.integers(-1, 2, 6) / 64) for i in range(60)] + [(None, [1.0] * 6), (None, [2.0] * 6), pairs[10], pairs[10], (900, [1.0] * 5)]
    df = spark.createDataFrame(with_rest(pairs), VECTORS).repartition(4)
    got = lloyd.lloyd_clusters(df, k=k, dim=6, block_rows=block_rows)
    assert Counter(map(tuple, got.collect())) == plain_lloyd(pairs, k, 3, 6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert lloyd.lloyd_clusters(spark.createDataFrame(with_rest(ODD[:2]), VECTORS), dim=6).collect() == []


def test_components_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame(with_rest([(1, [1e30] * 6), (2, [1.0] * 6)]), VECTORS)
    with pytest.raises(Exception, match="too large"):
        lloyd.lloyd_clusters(df, dim=6).collect()


def test_trees_find_the_nearest_and_cover_tree_holds():
    draw = np.random.default_rng(7)
    for x in (draw.integers(-50, 50, (300, 3)), draw.integers(-2, 2, (200, 2)), np.zeros((40, 4), np.int64), draw.choice([-(1 << 26), 1 << 26], (100, 8)), np.repeat(draw.integers(0, 9, (5, 3)) * 1000, 40, axis=0) + draw.integers(0, 3, (200, 3))):
        tree = lloyd.CoverTree.of(x)
        assert sorted(tree.order) == list(range(len(x)))
        for n in range(len(tree.center)):
            below = x[tree.order[tree.first[n] : tree.last[n]]].astype(float)
            assert np.sqrt(((below - x[tree.center[n]]) ** 2).sum(axis=1)).max() <= tree.radius[n]
            kids = range(tree.child[n], tree.child[n] + tree.n_children[n])
            if kids:
                assert tree.center[kids[0]] == tree.center[n] and tree.first[kids[0]] == tree.first[n] and tree.last[kids[-1]] == tree.last[n]
                apart = [np.sqrt(((x[tree.center[a]] - x[tree.center[b]]).astype(float) ** 2).sum()) for a in kids for b in kids if a < b]
                assert not apart or min(apart) > 2.0 ** (math.ceil(math.log2(tree.radius[n])) - 1)
        for cents in (x[:1], x[draw.choice(len(x), 20)], x[:20] + 1):
            cluster, best = lloyd.nearest(x, tree, cents, lloyd.CoverTree.of(cents))
            all_pairs = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
            assert (cluster == all_pairs.argmin(axis=1)).all() and (best == all_pairs.min(axis=1)).all()


# Divergence of sources


def plain_divergence(rows, min_docs, top):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))) for t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in in_docs.items() if n >= min_docs}
        times = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(times.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(whole)
        for s, c in times.items():
            own_p = p(c)
            pairs = [(-sum(f(own_p[t], x) for t, x in p(other).items()), o.encode()) for o, other in times.items() if o != s]
            terms = [(-f(own_p[t], q[t]), t.encode()) for t in kept if c[t] and own_p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, n + 1) for n, (v, item) in enumerate(sorted(found)[:most])]
    return Counter(out)


def sources(draw):
    vocabulary = ["".join(draw.choice(list("abCdEéÉñ日"), draw.integers(1, 4))) for _ in range(80)]
    rows = []
    for i in range(160):
        words = draw.choice(vocabulary[: 20 + 3 * (i % 20)], draw.integers(0, 40))
        source = "hot" if i % 3 == 0 else f"s{i % 11}"
        rows.append((" ".join(words) + ("-x1y" if i % 2 else "_Z'Z"), ["en", "de", ""][i % 7 % 3], source))
    rows += [(None, "en", "silent"), ("", None, None), ("a b", "en", None), ("...", "xx", "lone"), ("rare", "yy", "p"), ("words", "yy", "q"), (None, "zz", "a"), (None, "zz", "b")]
    return rows + [rows[5], rows[5], ("Deadly " * 3000, "en", "hot")]


@pytest.mark.parametrize("options", [{}, {"block": 2, "chunk_terms": 7, "span_chunks": 2, "held": 30}])
def test_divergence(spark, options):
    rows = sources(np.random.default_rng(8))
    df = spark.createDataFrame([(i, t, g, s, 1, "p", 2) for i, (t, g, s) in enumerate(rows)], DOCS).repartition(5)
    got = source_divergence.source_divergence(df, min_docs=4, top=5, **options)
    assert Counter(map(tuple, got.collect())) == plain_divergence(rows, 4, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert source_divergence.source_divergence(df.where("false")).collect() == []


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(source_divergence, "_PIECE", 16)
    for text in ("Ab1cd " * 50, "x" * 100 + " y", "1" * 40 + "word" * 9, "é日" * 30 + ".", "a", ""):
        whole = [m.lower().encode() if m.isascii() else m.encode() for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        assert [t for part in source_divergence.terms_of(text.encode()) for t in part] == whole


def test_share_stays_exact_beyond_what_a_product_can_hold(spark):
    counts = np.array([0, 1, 10**12, 9 * 10**14], np.int64)
    size = 10**15 + 7
    assert source_divergence.share(counts, size).tolist() == [1 + 10**9 * (c + 2) // size for c in counts.tolist()]
    df = spark.createDataFrame([(int(c),) for c in counts], "c long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(source_divergence.share_column(F.col("c"), F.lit(size))).collect()] == [1 + 10**9 * (c + 2) // size for c in counts.tolist()]
