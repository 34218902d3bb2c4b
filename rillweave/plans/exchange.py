"""Lists read and exports written and read again, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten
from ..sources import exporters, lists, page_shards
from ..sources.shared import fresh_path
from .tables import pages, table


def _list_file(spark: SparkSession, rows: DataFrame, line: F.Column) -> str:
    path = fresh_path(spark, "list")
    rows.select(line.alias("value")).write.text(path)
    return path


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of a file with blanks, comments and white space around lines, after literals."""
    k = F.col("page_id")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), "url")).when(k % 7 == 0, F.lit(" \t")).when(k % 3 == 0, F.concat(F.lit("  "), "url", F.lit("\t "))).otherwise(F.col("url"))
    got = lists.urls(spark, _list_file(spark, pages(spark, sf_dir), line), ["http://literal/a", "http://literal/b"])
    return got.select("url", (F.col("seq") < 2).alias("literal"))


def proxy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    line = F.when(n % 4 == 0, F.lit("#off")).otherwise(F.concat(F.lit(" http://p"), n.cast("string"), F.lit(":8080")))
    return lists.proxies(spark, _list_file(spark, table(spark, sf_dir, "nation"), line)).select("proxy")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested records with nulls, quotes, delimiters, line feeds and letters beyond ASCII."""
    k = F.col("c_custkey")
    note = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit('say "hi", é')).when(k % 4 == 2, F.lit("a;b")).otherwise(F.lit("x y"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), note.alias("note"), (k % 2 == 0).alias("even"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("at"))


_KINDS = "c_custkey long, name string, note string, even boolean, at struct<nation: int, segment: string>"
_FLAT = "at_nation int, at_segment string, c_custkey long, even boolean, name string, note string"


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one array and read back."""
    path = exporters.to_json(_records(spark, sf_dir).repartition(3, "c_custkey"), fresh_path(spark, "json"))
    return spark.read.schema(_KINDS).option("multiLine", True).json(path).select("*", "at.nation", "at.segment").drop("at")


def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as lines; null fields are there."""
    path = exporters.to_jsonl(_records(spark, sf_dir), fresh_path(spark, "jsonl"))
    text = spark.read.text(path)
    return text.select(F.from_json("value", _KINDS).alias("r"), F.contains("value", F.lit('"note":')).alias("has_note")).select("r.c_custkey", "r.name", "r.note", "r.even", "r.at.nation", "r.at.segment", "has_note")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in parts with flat columns, made one file, read back by its header."""
    parts = exporters.to_csv(_records(spark, sf_dir).repartition(3, "c_custkey"), fresh_path(spark, "csv"), ";")
    path = exporters.single_file(parts, fresh_path(spark, "one"), header=True)
    return spark.read.schema(_FLAT).option("header", True).option("sep", ";").option("escape", '"').csv(path)


def sqlite_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a table in one file and read back with types and nulls."""
    path = exporters.to_sqlite(_records(spark, sf_dir).repartition(3, "c_custkey"), f"{fresh_path(spark, 'sqlite')}.db")
    return exporters.read_sqlite(spark, path).drop("_scraped_at", "id")


def sqlite_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to shards in two goes, and read back with their types; the source picks rows with a note and by key."""
    k = F.col("page_id")
    note = F.when(k % 3 != 0, F.concat(F.lit("n "), k.cast("string")))
    rows = pages(spark, sf_dir).select("page_id", (k * 1.25).cast("decimal(12,2)").alias("price"), F.date_add(F.lit("2024-02-27").cast("date"), (k % 400).cast("int")).alias("day"), F.timestamp_seconds(k * 1001).alias("at"), (k % 2 == 0).alias("even"), note.alias("note"), "html")
    path = fresh_path(spark, "pages")
    exporters.to_sqlite_shards(rows.where("page_id % 4 < 2"), path)
    exporters.to_sqlite_shards(rows.where("page_id % 4 >= 2"), path)
    return exporters.read_sqlite(spark, path).where("note is not null and page_id > 20").withColumn("html", F.md5("html"))


def _shards(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pages as JSON lines."""
    path = fresh_path(spark, "shards")
    pages(spark, sf_dir).select("url", "html", "page_id").write.json(path)
    page_shards.register(spark)
    return path


def shard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read through the page source, those of one scheme, which the source picks."""
    got = spark.read.format("page_shards").option("path", _shards(spark, sf_dir)).load().where("startswith(url, 'https://')")
    return got.select("url", "host", F.octet_length("html").cast("long").alias("n_bytes"), F.md5("html").alias("html_md5"))


def shard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder as a stream, whose rows are written as they come; only page_id and host are parsed."""
    stream = spark.readStream.format("page_shards").schema("page_id long, host string").option("path", _shards(spark, sf_dir)).load()
    out = fresh_path(spark, "streamed")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("page_id long, host string").parquet(out)


def open_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose keys differ from row to row, some no objects: a CSV file under the union of their keys, read back by its header."""
    k, text = F.col("page_id"), lambda *columns: F.to_json(F.struct(*columns))
    meta = lambda c, name: F.struct(c.alias(name)).alias("meta")
    size = F.length("html")
    made = (
        F.when(k % 5 == 0, text(k.alias("id"), "url", meta(size, "chars")))
        .when(k % 5 == 1, text(k.alias("id"), F.array(F.lit("x"), "url").alias("tags")))
        .when(k % 5 == 2, text(k.alias("id"), (k / 4).alias("price"), meta(F.md5("html"), "md5 of html")))
        .when(k % 5 == 3, text(k.cast("string").alias("id"), F.lit("n/a").alias("price")))
        .otherwise(F.concat(F.lit("["), "url"))
    )
    records = flatten.open_records(pages(spark, sf_dir).select(made.alias("line")).where("line is not null"), "line")
    path = exporters.to_csv(records.where("record is not null").select("record.*"), fresh_path(spark, "open"))
    names = "id string, meta_chars long, `meta_md5 of html` string, price string, tags string, url string"
    return spark.read.schema(names).option("header", True).option("escape", '"').csv(path).withColumnRenamed("meta_md5 of html", "meta_md5")


def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are prepared for a database, with the type that each column would have."""
    rows = flatten.prepared(_records(spark, sf_dir))
    kinds = F.lit("|".join(f"{f.name}:{flatten.sql_type(f.dataType)}" for f in rows.schema.fields))
    return rows.select("c_custkey", "at", kinds.alias("kinds"))


QUERIES = {f.__name__: f for f in (url_list, proxy_list, json_export, jsonl_export, csv_export, sqlite_export, sqlite_shards, shard_pages, shard_stream, open_export, column_types)}

_HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
_R = """r AS (SELECT c_custkey, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'say "hi", é' WHEN 2 THEN 'a;b' ELSE 'x y' END AS note, c_custkey % 2 = 0 AS even, c_nationkey AS nation, c_mktsegment AS segment FROM customer)"""
_AT = """'{"nation":' || nation || ',"segment":"' || segment || '"}'"""
ORACLE_SQL = {
    "url_list": "SELECT url, false AS literal FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0 UNION ALL SELECT * FROM (VALUES ('http://literal/a', true), ('http://literal/b', true)) AS t(url, literal)",
    "proxy_list": "SELECT 'http://p' || n_nationkey || ':8080' AS proxy FROM nation WHERE n_nationkey % 4 <> 0",
    "json_export": f"WITH {_R} SELECT * FROM r",
    "jsonl_export": f"WITH {_R} SELECT *, true AS has_note FROM r",
    "csv_export": f"WITH {_R} SELECT nation AS at_nation, segment AS at_segment, c_custkey, even, name, note FROM r",
    "sqlite_export": f"WITH {_R} SELECT c_custkey, name, note, even::BIGINT AS even, {_AT} AS at FROM r",
    "sqlite_shards": "SELECT page_id, (page_id * 1.25)::DECIMAL(12,2) AS price, ('2024-02-27'::DATE + (page_id % 400)::INTEGER)::DATE AS day, to_timestamp(page_id * 1001) AS at, page_id % 2 = 0 AS even, 'n ' || page_id AS note, md5(html) AS html FROM pages WHERE page_id % 3 <> 0 AND page_id > 20",
    "open_export": """SELECT page_id::VARCHAR AS id, CASE WHEN page_id % 5 = 0 THEN length(html) END::BIGINT AS meta_chars, CASE WHEN page_id % 5 = 2 THEN md5(html) END AS meta_md5,
        CASE page_id % 5 WHEN 2 THEN regexp_replace((page_id / 4.0::DOUBLE)::VARCHAR, '[.]0$', '') WHEN 3 THEN 'n/a' END AS price, CASE WHEN page_id % 5 = 1 THEN '["x","' || url || '"]' END AS tags, CASE WHEN page_id % 5 = 0 THEN url END AS url FROM pages WHERE page_id % 5 <> 4""",
    "shard_pages": f"SELECT url, {_HOST} AS host, strlen(html)::BIGINT AS n_bytes, md5(html) AS html_md5 FROM pages WHERE starts_with(url, 'https://')",
    "shard_stream": f"SELECT page_id, {_HOST} AS host FROM pages",
    "column_types": f"WITH {_R} SELECT c_custkey, {_AT} AS at, 'c_custkey:INTEGER|name:TEXT|note:TEXT|even:INTEGER|at:TEXT' AS kinds FROM r",
}
