"""The test tables, and inputs made from them for operators that the raw tables would not exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out if it comes in fewer partitions than there are cores: a small file that can't be split, before costly work on its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def spa_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, some turned into application shells or given framework markers."""
    kind, html = F.col("page_id") % 7, F.col("html")
    return pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.when(kind == 0, F.lit('<html><body><div id="root"></div><script src="/static/react-dom.js"></script></body></html>'))
        .when(kind == 1, F.concat(html, F.lit('<script id="__NEXT_DATA__">{}</script>')))
        .when(kind == 2, F.concat(F.lit('<div id="app"> </div><script>window.__INITIAL_STATE__={}; hydrate (x)</script><i data-v-1f>'), html))
        .when(kind == 3, F.concat(html, F.lit('<link href="/_nuxt/entry.js"><p class="svelte-a1b2">')))
        .otherwise(html)
        .alias("html"),
    )
