"""The pipeline's stages, each against a plain version on its own input."""

import base64
import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from rillweave.llm import quality_classifier
from test_operators import SPACE, plain_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    say = lambda n: " ".join("".join(draw.choices("abcdef", k=draw.randint(2, 6))) for _ in range(n))
    texts = [say(draw.randint(20, 80)) for _ in range(60)]
    texts += [t.replace(" ", "\n", 3) for t in texts[:10]] + [t + " end" for t in [say(600) for _ in range(3)] * 2] + [None, "", " "]
    junk = [" ".join(x + "###" for x in say(40).split()) for _ in range(30)]
    rows = [(i, t, "en", draw.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts + junk)]
    rows += [rows[3], (None, texts[4], "en", "a", 0), (None, None, None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < len(texts)), 0) for i in range(len(texts) + len(junk)) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return Counter(tuple(r) for r in df.select(pipeline.COLUMNS).collect())


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)

    def step(name, docs):
        stages[name](spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = step("quality_classifier", docs)
    said = {r.doc_id: r.predicted for r in quality_classifier.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("doc_id is not null").collect()}
    assert Counter({r: n for r, n in rows_of(docs).items() if r[0] is not None and said[r[0]]}) == Counter({r: n for r, n in rows_of(good).items() if r[0] is not None})
    assert any(not v for v in said.values())

    single, first = step("exact_dedup", docs), {}
    digest = lambda t: hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()
    for r in rows_of(docs):
        if r[0] is not None:
            first[digest(r[1])] = min(first.get(digest(r[1]), math.inf), r[0])
    assert rows_of(single) == Counter({r: 1 for r, n in rows_of(docs).items() if first[digest(r[1])] == r[0]})  # of replayed rows one stays

    near = step("simhash_near_dedup", single)
    kept = list(rows_of(single))
    label = plain_similar([r[0] for r in kept], [r[1] for r in kept])
    assert rows_of(near) == Counter(kept[i] for i in set(label))

    mixed = step("source_mixing", near)
    sizes = Counter()
    for r, n in rows_of(near).items():
        sizes[r[3]] += n * len((r[1] or "").encode())
    want, all_weight = Counter(), sum(math.sqrt(b) for b in sizes.values())
    for r, n in rows_of(near).items():
        rate = sum(sizes.values()) * math.sqrt(sizes[r[3]]) / all_weight / sizes[r[3]] if sizes[r[3]] else 0
        chance = (int(hashlib.sha256(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        copies, term = 0, math.exp(-rate)
        total = term
        while rate and total < chance:
            copies += 1
            term *= rate / copies
            total += term
        want[r] += n * copies
    assert rows_of(mixed) == +want

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded), r.n_tokens) for r in step("bpe_encoding", mixed).collect())
    assert got == Counter({(r[0], tuple(ids := plain.encode_ordinary(r[1] or "")), (r[1] or "").encode(), len(ids)): n for r, n in rows_of(mixed).items()})


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_keeps_one_row_of_null_ids(spark):
    rows = [(None, "a  b", "en", "x", 4), (None, "a b", "en", "y", 3), (None, "a b", "en", "y", 3), (None, "c", "en", "x", 1), (2, "c", "en", "x", 1), (7, "d", "en", "x", 1)]
    got = [tuple(r) for r in pipeline.exact(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(r for r in got if r[0]) == sorted(rows[4:]) and len([r for r in got if r[0] is None and r[1] != "c"]) == 1 and len(got) == 3
