"""The page source: ranges, columns, filters, streams, odd lines."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillweave.functions.urls import domain
from rillweave.sources import page_shards
from rillweave.sources.page_shards import Lines, Range, blocks, planned


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    page_shards.register(spark)
    draw, folder = random.Random(4), tmp_path_factory.mktemp("shards")
    rows = [{"url": draw.choice(["https://a.example/x", "http://b.example:80/é", "//c/", "none", None, 'https://q"uote/"', "https://a.example"]) , "html": "<p>" + draw.choice(["é\n", '"', "\\", "日本"]) * draw.randint(0, 400), "n": i, "tags": ["t"] * (i % 3)} for i in range(300)]
    for k in range(3):
        part = [dict(r, url=r["url"] and r["url"] + str(r["n"] % 7)) for r in rows[k::3]]
        rows[k::3] = part
        (folder / "in").mkdir(exist_ok=True)
        text = "\n".join(json.dumps(r, ensure_ascii=draw.random() < 0.5) for r in part)
        (folder / f"in/part-{k}.json").write_bytes(text.encode() + b"\n\n" * (k == 1))
    (folder / "in/_SUCCESS.json").write_text("no page")
    return str(folder), rows


def load(spark, folder, schema=None, **options):
    reader = spark.read.format("page_shards").options(path=f"{folder}/in", **options)
    return (reader.schema(schema) if schema else reader).load()


def host_of(url):
    from urllib.parse import urlsplit

    return None if url is None else urlsplit(url).netloc


@pytest.mark.parametrize("size", [200, 5000, 1 << 25])
def test_every_line_is_read_once_whatever_the_ranges(spark, shards, size):
    folder, rows = shards
    df = load(spark, folder, rangeBytes=size)
    assert df.columns == ["url", "host", "html", "shard"]
    assert sorted((r.url, r.host, r.html, r.shard) for r in df.where("url is not null").collect()) == sorted((r["url"], host_of(r["url"]), r["html"], f"part-{r['n'] % 3}.json") for r in rows if r["url"] is not None)
    assert df.count() == len(rows) and (df.rdd.getNumPartitions() > 100) == (size == 200)


def test_host_is_what_the_column_expression_says(spark, shards):
    assert load(spark, shards[0]).where(~F.col("host").eqNullSafe(domain(F.col("url")))).count() == 0


def test_ranges_and_blocks_over_all_cuts():
    lines = [b"a", b"", b"bcd" * 5, b"e", b"fg" * 9]
    for data in (b"\n".join(lines), b"\n".join(lines) + b"\n", b"", b"\n"):
        want = [x for x in data.split(b"\n") if x]
        for size in (1, 3, 64):
            for cut in range(1, len(data) + 1):
                got = []
                for part in planned([Range("f", 0, len(data))], cut):
                    for r in part.parts:
                        for block in blocks(pa.BufferReader(data), r.start, r.end, size):
                            got += [x for x in block.split(b"\n") if x]
                assert got == want


def test_filters_are_taken_over_and_exact(spark, shards):
    folder, rows = shards
    for condition, python in (
        ("host = 'a.example2'", lambda r: host_of(r["url"]) == "a.example2"),
        ("host in ('b.example:80', 'c', 'a.example3')", lambda r: host_of(r["url"]) in ("b.example:80", "c", "a.example3")),
        ("host = ''", lambda r: host_of(r["url"]) == ""),
        ("url like 'http://b.example:80/é%'", lambda r: (r["url"] or "").startswith("http://b.example:80/é")),
        ("startswith(url, 'https://q\"uote')", lambda r: (r["url"] or "").startswith('https://q"uote')),
        ("host = 'a.example2' and length(html) > 9", lambda r: host_of(r["url"]) == "a.example2" and len(r["html"]) > 9),
        ("host = 'a.example2' or host = 'c'", lambda r: host_of(r["url"]) in ("a.example2", "c")),
        ("host is null", lambda r: r["url"] is None),
    ):
        got = load(spark, folder, rangeBytes=3000).where(condition)
        assert sorted((r.html or "") for r in got.collect()) == sorted(r["html"] for r in rows if python(r)), condition
    plan = load(spark, folder).where("host = 'c' and length(html) > 9")._jdf.queryExecution().executedPlan().toString()
    assert "(host#" not in plan.split("BatchScan")[0].replace("isnotnull(host#", "")  # the equality isn't checked again
    formatted = spark._jvm.PythonSQLUtils.explainString(load(spark, folder).where("host = 'c'")._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(host,c)" in formatted


def test_lines_that_cannot_pass_are_not_parsed(monkeypatch):
    read, seen = Lines._read, []
    monkeypatch.setattr(Lines, "_read", lambda self, block: seen.append(block.count(b"\n") + 1) or read(self, block))
    schema = StructType.fromDDL("url string, host string")
    data = b"\n".join(json.dumps({"url": f"http://h{i}/", "html": "\\ http://h7/"}).encode() for i in range(50))
    from pyspark.sql.datasource import EqualTo

    got = list(Lines(schema, [EqualTo(("host",), "h7")], False).batches(data, "s"))
    assert seen == [1] and [b.to_pylist() for b in got] == [[{"url": "http://h7/", "host": "h7"}]]


def test_only_the_columns_asked_for_are_parsed(spark, shards):
    folder, rows = shards
    assert Lines(StructType.fromDDL("host string"), [], False).parsed.names == ["url"]
    assert Lines(StructType.fromDDL("shard string, n long"), [], False).parsed.names == ["n"]
    got = load(spark, folder, "n long, tags array<string>, host string, none string")
    assert sorted((r.n, r.tags, r.none) for r in got.collect()) == [(r["n"], r["tags"], None) for r in rows]


def test_malformed_lines_and_empty_folders(spark, tmp_path):
    page_shards.register(spark)
    os.mkdir(tmp_path / "in")
    assert load(spark, tmp_path).collect() == [] and load(spark, tmp_path / "missing").collect() == []
    (tmp_path / "in/a.json").write_text('{"url": "http://a/"}\nno json\n{"url": 5}\n{"html": "x"}\n')
    with pytest.raises(Exception, match="JSON"):
        load(spark, tmp_path).collect()
    assert [(r.url, r.html) for r in load(spark, tmp_path, mode="dropMalformed").collect()] == [("http://a/", None), (None, "x")]


def test_a_stream_reads_what_is_whole_and_goes_on_where_it_was(spark, tmp_path):
    page_shards.register(spark)
    os.mkdir(tmp_path / "in")
    line = lambda n: json.dumps({"url": f"http://h/{n}", "html": "x" * n}) + "\n"

    def run():
        stream = spark.readStream.format("page_shards").options(path=f"{tmp_path}/in", rangeBytes=300).load()
        asked = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        asked.awaitTermination()
        return sorted(int(r.url.rpartition("/")[2]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in/a.json").write_text("".join(map(line, range(20))) + line(99)[:-5])
    assert run() == [*range(20)]
    with open(tmp_path / "in/a.json", "a") as f:
        f.write(line(99)[-5:] + line(100))
    (tmp_path / "in/b.json").write_text(line(200) + line(201))
    assert run() == [*range(20), 99, 100, 200, 201]
    assert run() == [*range(20), 99, 100, 200, 201]
