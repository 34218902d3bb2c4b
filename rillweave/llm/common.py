"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, everywhere in this subpackage: the six ASCII characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\r\x0b\x0c"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names none, one is made if driver and executors are one machine; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rillweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, kind: str = "table", by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder, in folders by these columns, and read it back: later uses neither recompute it nor depend on executors that hold it."""
    path = fresh_path(df.sparkSession, kind)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out and written once if it comes in fewer partitions than there are cores: small files that can't be split. Tables in more partitions, as all large ones are, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut(df.repartition(cores), "spread") if df.rdd.getNumPartitions() < cores else df


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """Like cut, in as many buckets of this column as a shuffle has partitions: joins on it and other columns with what by_pid deals out don't shuffle these rows.

    For that the session is told that a part of a join's keys is enough to place rows.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name, path = f"rillweave_{uuid.uuid4().hex}", fresh_path(spark, "rows")
    df.write.format("parquet").bucketBy(_buckets(spark), by).option("path", path).saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry in the catalogue; the files stay
    return read


def by_pid(df: DataFrame, column: str) -> DataFrame:
    return df.repartition(_buckets(df.sparkSession), column)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null is empty."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts are Python objects at a time; at the end free memory goes back, since workers stay for other tasks."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the half-open spans, which are sorted and disjoint."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept)
