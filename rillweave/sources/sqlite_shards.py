"""SQLite tables as a data source of Spark's: written as shards by tasks, committed together, read back by ranges.

    register(spark)
    df.write.format("sqlite_shards").option("path", folder).mode("append").save()
    spark.read.format("sqlite_shards").option("path", folder).load()

Each task writes a database of its own, `<job>-<id>.db`, in one transaction, and tells the driver
its name and how many rows it has. Only when all tasks are done is the manifest `_shards.json` replaced,
which names the databases that count: files of attempts that were repeated or broke off are never in it and are
deleted. No row passes through the driver. `overwrite` replaces the list, then deletes what it named.

Tables have a surrogate key `id`, the columns and `_scraped_at`, the time of insertion. Booleans are 0 and 1,
decimals, dates and times text; the manifest keeps Spark's types, and they come back, nulls as nulls. A path to
one SQLite file reads any table of it, with types by its declarations. Columns that a schema leaves out are not read, and
simple comparisons of numbers and strings go into the WHERE clause.

Options: path, table ("scraped_data"), rangeRows (100,000). SQLite needs local files: on other file systems a shard is
made and read through a temporary file of the task's own, which goes with the task.
"""

from __future__ import annotations

import contextlib
import datetime
import decimal
import json
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.flatten import sql_type
from .page_shards import file_system

MANIFEST = "_shards.json"
_ROWS = 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def declared(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return "TEXT"  # a REAL would round it
    return "BLOB" if isinstance(kind, T.BinaryType) else sql_type(kind)


def create_table(table: str, schema: T.StructType) -> str:
    fields = "".join(f"{quoted(f.name)} {declared(f.dataType)}, " for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {quoted(table)} (id INTEGER PRIMARY KEY AUTOINCREMENT, {fields}_scraped_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)"


def stored(value):
    """A value as SQLite has it."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime.datetime):
        return (value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value).isoformat(" ")
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value


def loaded(kind: pa.DataType):
    """What makes a stored value one of this type again."""
    if pa.types.is_boolean(kind):
        return bool
    if pa.types.is_timestamp(kind):
        zone = datetime.UTC if kind.tz else None
        return lambda v: datetime.datetime.fromisoformat(v).replace(tzinfo=zone)
    if pa.types.is_date(kind):
        return datetime.date.fromisoformat
    if pa.types.is_decimal(kind):
        return decimal.Decimal
    if pa.types.is_floating(kind):
        return float
    return str if pa.types.is_string(kind) else lambda v: v


@contextlib.contextmanager
def local_file(path: str, keep: bool) -> Iterator[str]:
    """A local path for a database at this one; one that is elsewhere is a temporary copy, which keep puts in place at the end."""
    system, place = file_system(path)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        yield place
        return
    handle, copy = tempfile.mkstemp(suffix=".db")
    os.close(handle)
    try:
        if not keep:
            with system.open_input_stream(place) as source, open(copy, "wb") as target:
                while piece := source.read(1 << 20):
                    target.write(piece)
        yield copy
        if keep:
            with open(copy, "rb") as source, system.open_output_stream(place) as target:
                while piece := source.read(1 << 20):
                    target.write(piece)
    finally:
        os.remove(copy)


def read_manifest(folder: str) -> dict | None:
    """schema, table and shards (name, rows); None if nothing has been written."""
    system, place = file_system(folder)
    at = f"{place}/{MANIFEST}"
    if system.get_file_info(at).type != pyarrow.fs.FileType.File:
        return None
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


# Writing


@dataclass
class Shard(WriterCommitMessage):
    name: str
    rows: int


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.folder, self.table, self.overwrite = schema, options["path"].rstrip("/"), options.get("table", "scraped_data"), overwrite
        self.job = uuid.uuid4().hex[:12]
        for f in schema.fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                raise ValueError(f"column {f.name} is not a plain one; flatten or prepare the rows first")
            if f.name.lower() in ("id", "_scraped_at"):
                raise ValueError(f"column {f.name} has the name of one that the table adds")
        system, place = file_system(self.folder)
        system.create_dir(place, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shard:
        name, rows = f"{self.job}-{uuid.uuid4().hex}.db", 0
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        marks = ", ".join("?" * len(self.schema.fields))
        with local_file(f"{self.folder}/{name}", keep=True) as path:
            con = sqlite3.connect(path, isolation_level=None)
            try:
                con.execute("PRAGMA journal_mode = OFF")  # a shard that breaks off never counts
                con.execute("PRAGMA synchronous = OFF")
                con.execute("BEGIN")
                con.execute(create_table(self.table, self.schema))
                for batch in batches:
                    for at in range(0, batch.num_rows, _ROWS):
                        part = batch.slice(at, _ROWS)
                        values = [map(stored, c.to_pylist()) for c in part.columns]
                        con.executemany(f"INSERT INTO {quoted(self.table)} ({columns}) VALUES ({marks})", zip(*values, strict=True))
                        rows += part.num_rows
                con.execute("COMMIT")
            finally:
                con.close()
        return Shard(name, rows)

    def commit(self, messages: list[Shard | None]) -> None:
        system, place = file_system(self.folder)
        before = read_manifest(self.folder)
        done = [{"name": m.name, "rows": m.rows} for m in messages if m]
        schema = json.loads(self.schema.json())
        if before and not self.overwrite:
            kinds = lambda s: [(f["name"], f["type"]) for f in s["fields"]]
            if before["table"] != self.table or kinds(before["schema"]) != kinds(schema):
                raise ValueError("the shards that are there have another table or other columns")
            done = before["shards"] + done
        draft = f"{place}/_{self.job}.json"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"schema": schema, "table": self.table, "shards": done}).encode())
        system.move(draft, f"{place}/{MANIFEST}")
        kept = {s["name"] for s in done}
        self._delete([s["name"] for s in (before or {"shards": []})["shards"] if s["name"] not in kept], kept)

    def abort(self, messages: list[Shard | None]) -> None:
        self._delete([], set())

    def _delete(self, names: list[str], kept: set[str]) -> None:
        """These shards, and those of this job that don't count."""
        system, place = file_system(self.folder)
        own = [f.base_name for f in system.get_file_info(pyarrow.fs.FileSelector(place)) if f.base_name.startswith(f"{self.job}-") and f.base_name not in kept]
        for name in [*names, *own]:
            with contextlib.suppress(FileNotFoundError):
                system.delete_file(f"{place}/{name}")


# Reading


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str], manifest: dict):
        self.schema, self.folder, self.manifest = schema, options["path"].rstrip("/"), manifest
        self.most = int(options.get("rangeRows", 100_000))
        self.where: list[str] = []
        self.values: list = []

    def _comparable(self, name: str, values: list) -> bool:
        kind = self.schema[name].dataType if name in self.schema.names else None
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return all(isinstance(v, int) and not isinstance(v, bool) if whole else isinstance(kind, T.StringType) and isinstance(v, str) for v in values)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in _SIGNS else []
            if name in self.schema.names and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            elif name and values and self._comparable(name, values) and (type(f) in _SIGNS or isinstance(f, In)):
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{quoted(name)} {_SIGNS[type(f)]} ?")
                self.values += values
            else:
                yield f

    def partitions(self) -> list[Rows]:
        out = []
        for s in self.manifest["shards"]:
            path = f"{self.folder}/{s['name']}" if s["name"] else self.folder
            out += [Rows(path, a, a + self.most) for a in range(s.get("first", 1), s.get("first", 1) + s["rows"], self.most)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = to_arrow_schema(self.schema)
        names = ", ".join(quoted(n) for n in self.schema.names) or "1"
        condition = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        with local_file(partition.path, keep=False) as path:
            con = sqlite3.connect(path)
            try:
                con.execute("PRAGMA query_only = ON")
                found = con.execute(f"SELECT {names} FROM {quoted(self.manifest['table'])} WHERE {condition}", [partition.first, partition.last, *self.values])
                while rows := found.fetchmany(_ROWS):
                    columns = [pa.array([None if v is None else make(v) for v in column], k) for column, k, make in zip(zip(*rows, strict=True), kinds.types, map(loaded, kinds.types), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)
            finally:
                con.close()


#: Of a file that this source didn't write: types by the first word of a declaration.
_DECLARED = {"INTEGER": T.LongType(), "INT": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}


def described(path: str, table: str) -> dict:
    """A file as a manifest: its columns, and its rows by the least and largest row number."""
    with local_file(path, keep=False) as place:
        con = sqlite3.connect(f"file:{place}?mode=ro", uri=True)
        try:
            columns = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
            if not columns:
                raise ValueError(f"no table {table} in {path}")
            least, most = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
        finally:
            con.close()
    fields = [T.StructField(c[1], _DECLARED.get((c[2].split() or [""])[0].upper(), T.StringType())) for c in columns]
    return {"schema": json.loads(T.StructType(fields).json()), "table": table, "shards": [{"name": "", "first": least, "rows": most - least + 1}] if least is not None else []}


class SqliteShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_shards"

    def _manifest(self) -> dict:
        path = self.options["path"].rstrip("/")
        system, place = file_system(path)
        if system.get_file_info(place).type == pyarrow.fs.FileType.File:
            return described(path, self.options.get("table", "scraped_data"))
        found = read_manifest(path)
        if not found:
            raise ValueError(f"no shards at {path}")
        return found

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._manifest()["schema"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options, self._manifest())

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and have filters offered to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteShards)


# One file


def one_file(spark: SparkSession, folder: str, path: str, replace: bool = False) -> str:
    """The shards of a folder as one table in one file, which a single task puts together and renames into place at the end; rows go after those of a file that is there, unless replace."""
    found = read_manifest(folder)
    schema = T.StructType.fromJson(found["schema"])

    def join(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(path)
        if not isinstance(system, pyarrow.fs.LocalFileSystem):
            raise ValueError("one SQLite file needs a path in a mounted file system")
        draft = f"{place}.{uuid.uuid4().hex}"
        try:
            if os.path.exists(place):
                pyarrow.fs.copy_files(place, draft, source_filesystem=system, destination_filesystem=system)
            con = sqlite3.connect(draft, isolation_level=None)
            try:
                table = quoted(found["table"])
                if replace:
                    con.execute(f"DROP TABLE IF EXISTS {table}")
                con.execute(create_table(found["table"], schema))
                columns = ", ".join([*(quoted(f.name) for f in schema.fields), "_scraped_at"])
                for s in found["shards"]:
                    with local_file(f"{folder}/{s['name']}", keep=False) as shard:
                        con.execute("ATTACH ? AS shard", [shard])
                        con.execute(f"INSERT INTO main.{table} ({columns}) SELECT {columns} FROM shard.{table} ORDER BY rowid")
                        con.execute("DETACH shard")
            finally:
                con.close()
            os.replace(draft, place)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(draft)
        yield pa.RecordBatch.from_pydict({"done": [True]})

    spark.range(1).repartition(1).mapInArrow(join, "done boolean").collect()  # one row
    return path


def delete_shards(folder: str) -> None:
    system, place = file_system(folder)
    system.delete_dir(place)
