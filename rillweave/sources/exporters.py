"""Exports: JSON array, JSON lines, CSV, SQLite.

Each writes a folder of part files in parallel, on any file system that Spark
writes to; JSON arrays and single files are the parts one after another, copied
as streams through the file system's own interface. SQLite databases are written
by tasks (sqlite_shards.py); one file of them is put together by one task.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import flatten, prepared
from . import sqlite_shards


def auto_filename(extension: str, now: datetime | None = None) -> str:
    return f"export_{(now or datetime.now()):%Y%m%d_%H%M%S}.{extension}"


def _system(spark: SparkSession, path: str):
    """The file system of a path, the path and the settings, on the JVM's side; a plain path is local if it is absolute."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place, conf


def _joined(spark: SparkSession, folder: str, path: str, head: bytes = b"", tail: bytes = b"", skip: int = 0, skip_line: bool = False) -> str:
    """The parts of a folder as one file between head and tail, without the first `skip` bytes of the first part, or with skip_line without the first line of each part but the first."""
    system, place, conf = _system(spark, folder)
    target, out_place, _ = _system(spark, path)
    parts = sorted((f.getPath() for f in system.listStatus(place) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = target.create(out_place, True)
    try:
        out.write(bytearray(head))
        for i, part in enumerate(parts):
            source = system.open(part)
            try:
                if skip and not i:
                    source.seek(skip)
                if skip_line and i:
                    while source.read() not in (10, -1):
                        pass
                copy(source, out, conf, False)
            finally:
                source.close()
        out.write(bytearray(tail))
    finally:
        out.close()
    return path


def to_jsonl(df: DataFrame, path: str) -> str:
    """One object a line, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def to_json(df: DataFrame, path: str, indent: bool = True) -> str:
    """One array in one file, its objects indented, or an object a line without indent. No rows give []."""
    spark, folder = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false", "pretty": str(indent).lower()})
    # Line feeds inside strings are escaped, so these are those between fields.
    df.select(F.concat(F.lit(",\n  "), F.replace(text, F.lit("\n"), F.lit("\n  "))).alias("value")).write.option("lineSep", " ").text(folder)
    try:
        return _joined(spark, folder, path, b"[", b"\n]", skip=1)
    finally:
        system, place, _ = _system(spark, folder)
        system.delete(place, True)


def to_csv(df: DataFrame, path: str, delimiter: str = ",", include_headers: bool = True, flatten_nested: bool = True) -> str:
    """Flat columns in order of name; nulls are empty. No rows are an error."""
    seen = Observation()
    flatten(df, flatten_nested).observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("sep", delimiter).option("header", include_headers).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    if not seen.get["n"]:
        system, place, _ = _system(df.sparkSession, path)
        system.delete(place, True)
        raise ValueError("no data to export")
    return path


def single_file(folder: str, path: str, header: bool = False) -> str:
    """The parts of a folder as one file; header: each part repeats the first line."""
    return _joined(SparkSession.active(), folder, path, skip_line=header)


def to_sqlite_shards(df: DataFrame, path: str, table: str = "scraped_data", mode: str = "append") -> str:
    """A folder of SQLite databases, one a task, that count together; complex columns as JSON text. No rows are an error."""
    path = _absolute(path)
    sqlite_shards.register(df.sparkSession)
    prepared(df).write.format("sqlite_shards").options(path=path, table=table).mode(mode).save()
    if not any(s["rows"] for s in sqlite_shards.read_manifest(path)["shards"]):
        sqlite_shards.delete_shards(path)
        raise ValueError("no data to export")
    return path


def to_sqlite(df: DataFrame, path: str, table: str = "scraped_data", replace: bool = False) -> str:
    """A table with a surrogate key and the time of insertion in one file, after what is there; complex columns as JSON text. No rows are an error.

    Tasks write shards beside it and one task joins them, so no row comes to the driver. The path must be one that executors share.
    """
    path = _absolute(path)
    folder = to_sqlite_shards(df, f"{path}.{uuid.uuid4().hex}", table)
    try:
        return sqlite_shards.one_file(df.sparkSession, folder, path, replace)
    finally:
        sqlite_shards.delete_shards(folder)


def _absolute(path: str) -> str:
    """A URI as it is, a local path from the root: tasks work in folders of their own."""
    return path if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path) else os.path.abspath(path)


EXPORTERS: dict[str, tuple[str, Callable[..., str]]] = {"json": ("json", to_json), "jsonl": ("jsonl", to_jsonl), "csv": ("csv", to_csv), "sqlite": ("db", to_sqlite), "sqlite_shards": ("shards", to_sqlite_shards)}


def register(kind: str, extension: str, write: Callable[..., str]) -> None:
    """Add an exporter: write(df, path, **options) gives the path that it wrote."""
    if kind in EXPORTERS:
        raise ValueError(f"export format is there already: {kind}")
    EXPORTERS[kind] = (extension, write)


def export(df: DataFrame, kind: str, folder: str, filename: str | None = None, **options) -> str:
    """Write df as one of the kinds under folder, which is made; the name is of the time if none is given."""
    if kind not in EXPORTERS:
        raise ValueError(f"unknown export format: {kind}")
    extension, write = EXPORTERS[kind]
    folder = _absolute(folder).rstrip("/")
    system, place, _ = _system(df.sparkSession, folder)
    system.mkdirs(place)
    return write(df, f"{folder}/{filename or auto_filename(extension)}", **options)


def read_sqlite(spark: SparkSession, path: str, table: str = "scraped_data") -> DataFrame:
    """A table of a SQLite file, with types by its declarations and nulls as they are, or of a folder of shards with the types they were written with."""
    sqlite_shards.register(spark)
    return spark.read.format("sqlite_shards").options(path=_absolute(path), table=table).load()
