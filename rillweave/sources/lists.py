"""URL and proxy lists from text files, and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, into: str = "url") -> DataFrame:
    """(seq, value): stripped lines but blank ones and those that start with #. seq grows with the line number in a file."""
    text = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias(into), F.monotonically_increasing_id().alias("seq"))
    return text.where((F.length(into) > 0) & ~F.startswith(F.col(into), F.lit("#"))).select("seq", into)


def urls(spark: SparkSession, path: str | None = None, literals: list[str] | None = None) -> DataFrame:
    """Literals first, then the lines of the file."""
    given = spark.createDataFrame([(i, u) for i, u in enumerate(literals or [])], "seq long, url string")
    if path is None:
        return given
    return given.unionByName(lines(spark, path).withColumn("seq", F.col("seq") + len(literals or [])))


def proxies(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, "proxy")


def page_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pages on disk (url, html) as a log of successful fetches."""
    p = spark.read.parquet(path)
    null = F.lit(None).cast("string")
    return p.select("url", F.lit(200).alias("status_code"), F.col("html").alias("content"), F.create_map().cast("map<string, string>").alias("headers"), F.lit(0.0).alias("response_time"), null.alias("error"), null.alias("used_proxy"))
