"""Every opN_ query over whole tables: against its SQL where it has one, else against a plain version; and over odd tables."""

import base64
import random
from collections import Counter
from zlib import crc32

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillweave.llm.queries import ORACLE_SQL, QUERIES
from test_operators import cached, padded_grams, plain_base, plain_fingerprint, plain_groups, plain_kneser_ney, words_of

SF = "/root/testdata/sf0.001"


def rows(table):
    names = sorted(table.schema.names)
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in zip(*(table[n].to_pylist() for n in names), strict=True)), names


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = rows(QUERIES[name](spark, SF).toArrow()), rows(con.sql(ORACLE_SQL[name]).to_arrow_table())
    assert got == want and got[0]


def test_op1(spark, documents):
    got = QUERIES["op1_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_op2(spark, documents):
    ids = list(documents)
    prints = [plain_fingerprint(documents[i], 3) for i in ids]
    label = plain_groups(ids, prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", label[p]) for i, p in zip(ids, prints, strict=True)}


def test_op6(spark, documents):
    from hashlib import sha256

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_bpe"](spark, SF).collect()}
    for i, t in documents.items():
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest())


def test_op8(spark, documents):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op8_tokens"](spark, SF).collect()}
    want = {i: len(plain.encode(t or "", add_special_tokens=False)) for i, t in documents.items()}
    assert got == {i: (len((documents[i] or "").encode()), n, n > 1024) for i, n in want.items()}


def test_op10(spark, documents):
    """Base counts of all rows; scores and bands from the definitions for the language with the fewest texts."""
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in QUERIES["op10_rules"](spark, SF).collect()}
    base = {i: plain_base(t) for i, t in documents.items()}
    for i, b in base.items():
        assert tuple(got[i])[:7] == (i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])
    size = Counter()
    for i, t in documents.items():
        size[langs[i]] += len(t or "")
    lang = min(size, key=size.get)
    own = [i for i in documents if langs[i] == lang]
    grams = {i: padded_grams(documents[i], 5) for i in own}
    p = cached(plain_kneser_ney([g for x in grams.values() for g in x], 5))
    for i in random.Random(1).sample(own, min(5, len(own))):
        if grams[i]:
            from math import log

            assert abs(got[i].log_perplexity + sum(log(p(g)) for g in grams[i]) / len(grams[i])) < 1e-4
    assert any(r.kept for r in got.values()) and not any(r.kept and r.base_failed for r in got.values())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, empty and very long texts, equal rows, columns whose names the operators use themselves."""
    draw = random.Random(77)
    say = lambda n: " ".join("".join(draw.choices("abcdeé", k=draw.randint(1, 8))) for _ in range(n))
    shared = say(80)
    texts = [None, "", " \n", say(70_000), say(60) + " " + shared, shared + " " + say(90), "x" * 300_000, "\u200b\U0001f9ff\u0558 " * 40, say(200), say(30)]
    made = [(i, t, draw.choice(["en", None]), draw.choice(["a", None]), len(t or ""), 1.0, 2, "c", 3, 4) for i, t in enumerate(texts)]
    made += [made[8], (None, texts[8], None, None, None, None, None, None, None, None)]
    path = tmp_path_factory.mktemp("odd")
    names = "doc_id long, text string, lang string, source string, n_chars long, rate double, pid int, cdf string, a long, id long"
    spark.createDataFrame(made, names).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None, None, 1), (2, "u", "p" * 200, 2), (3, "u", "p" * 200, 3), (None, "u", "", None)], "page_id long, url string, html string, digest int").write.parquet(f"{path}/pages.parquet")
    some = [(i, [float(i % 7 - 3 + j % 3) for j in range(64)], 0, "x") for i in range(60)]
    some += [some[20], (None, some[3][1], None, None), (100, None, 1, None), (101, [], 1, None), (102, [0.0] * 64, 1, None), (103, [None] * 64, 1, None), (104, [float("nan")] * 64, 1, None), (105, [1.0] * 3, 1, None)]
    spark.createDataFrame(some, "vec_id long, embedding array<float>, cell int, row string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path), made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_odd_tables(spark, odd, name):
    path, made = odd
    got = QUERIES[name](spark, path).collect()
    if name == "op5_warc":
        assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "response", None), (2, "response", None), (3, "revisit", 2), (None, "response", None)])
    elif name == "op11_neighbours":
        assert Counter(r.query_id for r in got) == {0: 20, 20: 40, 40: 20}
    elif name == "op12_lloyd":
        assert Counter(r.vec_id for r in got) == Counter([*range(60), 20, None, 102])
    elif name == "op13_divergence":
        assert all(r.value >= 0 and r.source != r.item for r in got) and any(r.part == "pair" for r in got)
    elif name != "op9_mixing":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in made)
    if name in ("op3_suffix", "op7_phrase"):
        assert all(r.n_removed == (r.n_bytes if name == "op3_suffix" else r.n_words) for r in got if r.doc_id in (8, None))
        assert next(r for r in got if r.doc_id == 9).n_removed == 0
    if name == "op7_phrase":
        assert next(r for r in got if r.doc_id == 4).n_removed == 80
    if name == "op8_tokens":
        plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        text = {r[0]: r[1] or "" for r in made}
        assert all(r.n_tokens == len(plain.encode(text[r.doc_id], add_special_tokens=False)) for r in got if r.doc_id is not None)
    if name == "op10_rules":
        assert {r.doc_id: r.n_words for r in got if r.doc_id is not None} == {r[0]: len(words_of(r[1])) for r in made if r[0] is not None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_empty_tables(spark, odd, tmp_path, name):
    for table in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd[0]}/{table}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
