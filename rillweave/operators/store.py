"""The raw-page store: an append-only log of saves and deletes, read latest-wins by storage key.

Log columns: url, url_hash, filename, content_type, stored_at (epoch seconds),
size_bytes, status_code, content, op (S or D).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import storage_filename, storage_key

META = ["url", "url_hash", "filename", "content_type", "stored_at", "size_bytes", "status_code"]


def save_rows(pages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log rows that save url, content, stored_at; content_type is html and status_code 200 where not given. by: further columns that the log keeps."""
    have = set(pages.columns)
    kind = F.coalesce(F.col("content_type"), F.lit("html")) if "content_type" in have else F.lit("html")
    status = F.coalesce(F.col("status_code"), F.lit(200)) if "status_code" in have else F.lit(200)
    url = F.col("url")
    return pages.select("url", storage_key(url).alias("url_hash"), storage_filename(url, kind).alias("filename"), kind.alias("content_type"), F.col("stored_at").cast("double").alias("stored_at"), F.octet_length("content").cast("long").alias("size_bytes"), status.cast("int").alias("status_code"), "content", F.lit("S").alias("op"), *by)


def delete_rows(urls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log rows that delete url at stored_at. by as in save_rows()."""
    null = lambda kind: F.lit(None).cast(kind)
    return urls.select("url", storage_key(F.col("url")).alias("url_hash"), null("string").alias("filename"), null("string").alias("content_type"), F.col("stored_at").cast("double").alias("stored_at"), null("long").alias("size_bytes"), null("int").alias("status_code"), null("string").alias("content"), F.lit("D").alias("op"), *by)


def latest(log: DataFrame, fields: list[str], by: Sequence[str] = ()) -> DataFrame:
    """fields and op of the latest row of each key, deletes too; at equal times deletes come first, then the larger size, then status and type; the larger MD5 of the content settles the rest, so that the order of rows never does and SQL can say the same.

    by: columns that go before the key, as those by which the rows lie already, or those that tell visits of a URL apart. An aggregate, not a window: partial maxima shrink a hot key before the shuffle.
    """
    told = [F.md5("content")] if "content" in fields else []  # last, so that reads without content find the same row
    order = F.struct("stored_at", F.col("op") == "S", "size_bytes", "url", "status_code", "content_type", *told)
    kept = [*dict.fromkeys([*fields, "url_hash", "op"])]
    inside = [c for c in kept if c != "url_hash"]
    found = log.groupBy(*by, F.col("url_hash").alias("__key")).agg(F.max_by(F.struct(*inside), order).alias("r"))
    # The key itself and not a copy of it from the row, so that a join by it finds the rows where they lie.
    return found.select(*by, *(F.col(f"r.{c}" if c in inside else "__key").alias(c) for c in kept))


def current(log: DataFrame, content: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The page held under each key: the latest log row unless it is a delete. by as in latest()."""
    fields = META + ["content"] if content else META
    return latest(log, fields, by).where("op = 'S'").select(*by, *fields)


def load(log: DataFrame, url: str) -> DataFrame:
    """The content held for a URL; no row if there is none."""
    key = storage_key(F.lit(url))
    return current(log.where(F.col("url_hash") == key)).select("content")


def metadata(log: DataFrame, url: str) -> DataFrame:
    """What is known of the page held for a URL but its content; no row if there is none."""
    key = storage_key(F.lit(url))
    return current(log.where(F.col("url_hash") == key), content=False)


def split_by_cache(urls: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """urls that are held, with their content, and urls to fetch."""
    keyed, held = urls.withColumn("__key", storage_key(F.col("url"))), current(log).select(F.col("url_hash").alias("__key"), "content")
    return keyed.join(held, "__key").drop("__key"), keyed.join(held.select("__key"), "__key", "left_anti").drop("__key")


def stats(log: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return current(log, content=False).agg(F.count("*").alias("total_files"), size.alias("total_size_bytes"), F.round(size / 1048576, 2).alias("total_size_mb"))


class RawStore:
    """The log as a plain Parquet folder: saves and deletes append, clear rewrites. generations.PageStore is the one for stores that live on.

    by: further columns (as DDL) of what is saved and deleted that tell visits of a URL apart; each is held on its own.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = ""):
        self.spark, self.path, self._by = spark, path, T.StructType.fromDDL(by) if by else T.StructType()

    def log(self) -> DataFrame:
        schema = T.StructType.fromDDL("url string, url_hash string, filename string, content_type string, stored_at double, size_bytes bigint, status_code int, content string, op string")
        schema = T.StructType([*schema, *self._by])
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def save(self, pages: DataFrame) -> None:
        save_rows(pages, self._by.names).write.mode("append").parquet(self.path)

    def delete(self, urls: DataFrame) -> None:
        delete_rows(urls, self._by.names).write.mode("append").parquet(self.path)

    def list_all(self) -> DataFrame:
        return current(self.log(), content=False, by=self._by.names)

    def clear(self) -> int:
        """Empty the store; how many pages it held."""
        n = self.list_all().count()
        self.spark.createDataFrame([], self.log().schema).write.mode("overwrite").parquet(self.path)
        return n
