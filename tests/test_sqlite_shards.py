"""SQLite shards: two phases, retries, types, ranges, filters, one file; exports to URIs."""

import datetime
import decimal
import json
import os
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillweave.sources import exporters, sqlite_shards
from rillweave.sources.sqlite_shards import ShardWriter, read_manifest

KINDS = "k long, flag boolean, x double, amount decimal(20,4), day date, at timestamp, raw binary, note string, small byte"
NOON = datetime.datetime(2024, 5, 1, 12, 0, 0, 250)
ROWS = [
    (1, True, 1.5, decimal.Decimal("123456789012345.6789"), datetime.date(2024, 2, 29), NOON, b"\x00\xff", 'say "é"', 3),
    (2, None, None, None, None, None, None, None, None),
    (3, False, float("inf"), decimal.Decimal("-0.1000"), datetime.date(1969, 1, 1), NOON, b"", "", -1),
]


def shards_of(folder):
    return sorted(n for n in os.listdir(folder) if n.endswith(".db"))


@pytest.fixture
def rows(spark):
    sqlite_shards.register(spark)
    return spark.createDataFrame(ROWS, KINDS)


def test_types_and_nulls_come_back(spark, rows, tmp_path):
    path = exporters.export(rows.repartition(2), "sqlite_shards", f"file://{tmp_path}", "s")
    back = exporters.read_sqlite(spark, path)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert sum(s["rows"] for s in read_manifest(path)["shards"]) == 3
    for s in shards_of(tmp_path / "s"):
        found = sqlite3.connect(tmp_path / "s" / s).execute("SELECT typeof(k), typeof(flag), typeof(amount), typeof(raw), _scraped_at FROM scraped_data WHERE k = 1").fetchall()
        assert all(r[:4] == ("integer", "integer", "text", "blob") and r[4] for r in found)


def test_appending_and_overwriting(spark, rows, tmp_path):
    path = f"{tmp_path}/s"
    for mode, n in (("append", 3), ("append", 6), ("overwrite", 3)):
        exporters.to_sqlite_shards(rows.repartition(2), path, mode=mode)
        assert exporters.read_sqlite(spark, path).count() == n
        assert set(shards_of(path)) == {s["name"] for s in read_manifest(path)["shards"]}
    with pytest.raises(Exception, match="other columns"):
        exporters.to_sqlite_shards(rows.drop("x"), path)
    assert exporters.read_sqlite(spark, path).count() == 3 and set(shards_of(path)) == {s["name"] for s in read_manifest(path)["shards"]}
    with pytest.raises(Exception, match="adds"):
        exporters.to_sqlite_shards(rows.withColumn("ID", F.lit(1)), path)


def test_only_committed_attempts_count(spark, rows, tmp_path):
    schema = StructType.fromDDL("k long, note string")
    batch = pa.RecordBatch.from_pylist([{"k": i, "note": f"n{i}"} for i in range(5)], schema=to_arrow_schema(schema))
    writer = ShardWriter(schema, {"path": str(tmp_path)}, overwrite=False)
    lost, again, other = (writer.write(iter([batch])) for _ in range(3))

    def breaks_off():
        yield batch
        raise OSError("the executor is gone")

    with pytest.raises(OSError, match="gone"):
        writer.write(breaks_off())
    assert len(shards_of(tmp_path)) == 4 and read_manifest(str(tmp_path)) is None
    writer.commit([again, None, other])
    assert shards_of(tmp_path) == sorted([again.name, other.name])
    assert sorted(r.k for r in exporters.read_sqlite(spark, str(tmp_path)).collect()) == sorted([*range(5)] * 2)
    second = ShardWriter(schema, {"path": str(tmp_path)}, overwrite=True)
    second.write(iter([batch]))
    second.abort([None])
    assert shards_of(tmp_path) == sorted([again.name, other.name]) and lost.rows == 5


def test_a_job_that_fails_leaves_what_was_there(spark, rows, tmp_path):
    path = exporters.to_sqlite_shards(rows, f"{tmp_path}/s")
    bad = rows.withColumn("note", F.when(F.col("k") < 3, "fine").otherwise(F.raise_error(F.lit("broken row")).cast("string")))
    with pytest.raises(Exception, match="broken row"):
        exporters.to_sqlite_shards(bad.repartition(3), path)
    assert exporters.read_sqlite(spark, path).count() == 3 and set(shards_of(path)) == {s["name"] for s in read_manifest(path)["shards"]}


def test_ranges_columns_and_filters(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), F.col("id") % 7)).alias("note")).withColumnRenamed("id", "k")
    path = exporters.to_sqlite_shards(df.repartition(2), f"{tmp_path}/s")
    read = lambda: spark.read.format("sqlite_shards").options(path=path, rangeRows=100).load()
    assert read().rdd.getNumPartitions() >= 10 and sorted(r.k for r in read().collect()) == [*range(1000)]
    for condition in ("k = 5", "k >= 10 and k < 20", "k in (1, 2, 3000)", "note = 'n3'", "note > 'n4'", "note is null and k > 990", "note in ('n0', 'n1') or k = 2", "k + 1 = 7"):
        assert sorted(map(tuple, read().where(condition).collect()), key=repr) == sorted(map(tuple, df.where(condition).collect()), key=repr), condition
    formatted = spark._jvm.PythonSQLUtils.explainString(read().where("k >= 10 and note = 'n3'")._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(k,10)" in formatted and "EqualTo(note,n3)" in formatted
    assert spark.read.format("sqlite_shards").schema("note string").options(path=path).load().where("note is not null").count() == 334


def test_one_file(spark, rows, tmp_path):
    nested = rows.select("k", "note", F.struct(F.lit(1).alias("a")).alias("s"))
    for replace, n in ((False, 3), (False, 6), (True, 3)):
        path = exporters.to_sqlite(nested.repartition(3), f"{tmp_path}/x.db", replace=replace)
        assert sqlite3.connect(path).execute("SELECT count(*), count(DISTINCT id), count(_scraped_at), count(note) FROM scraped_data").fetchone() == (n, n, n, n * 2 // 3)
    assert os.listdir(tmp_path) == ["x.db"]
    back = exporters.read_sqlite(spark, path)
    assert back.dtypes == [("id", "bigint"), ("k", "bigint"), ("note", "string"), ("s", "string"), ("_scraped_at", "string")]
    assert sorted((r.k, r.note, json.loads(r.s)["a"]) for r in back.collect() if r.note is not None) == [(1, 'say "é"', 1), (3, "", 1)]
    assert [r.k for r in back.where("note is null").collect()] == [2]
    for kind in ("sqlite", "sqlite_shards"):
        with pytest.raises(ValueError, match="no data"):
            exporters.export(nested.where("false"), kind, str(tmp_path), "none")
    assert os.listdir(tmp_path) == ["x.db"]
    with pytest.raises(Exception, match="no table"):
        exporters.read_sqlite(spark, path, "other")


@pytest.mark.parametrize("kind", ["json", "jsonl", "csv", "sqlite", "sqlite_shards"])
def test_exports_to_a_uri_make_no_stray_folders(rows, tmp_path, monkeypatch, kind):
    monkeypatch.chdir(tmp_path)
    path = exporters.export(rows.select("k", "note"), kind, f"file://{tmp_path}/deep/out", f"x.{kind}")
    assert path == f"file://{tmp_path}/deep/out/x.{kind}" and os.path.exists(f"{tmp_path}/deep/out/x.{kind}")
    assert os.listdir(tmp_path) == ["deep"]


def test_json_array_is_indented(spark, rows, tmp_path):
    path = exporters.to_json(rows.select("k", "note", F.array(F.lit("a\nb")).alias("list")).repartition(2), f"{tmp_path}/x.json")
    text = open(path, encoding="utf-8").read()
    assert sorted(r["k"] for r in json.loads(text)) == [1, 2, 3] and '\n    "note" : ' in text and json.loads(text)[0]["list"] == ["a\nb"]
    assert json.loads(open(exporters.to_json(rows.where("false"), f"{tmp_path}/none.json")).read()) == []
    assert open(exporters.to_json(rows.select("k").coalesce(1).sort("k"), f"{tmp_path}/plain.json", indent=False)).read() == '[\n  {"k":1} ,\n  {"k":2} ,\n  {"k":3} \n]'
