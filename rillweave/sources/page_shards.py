"""Pages in shards of JSON lines as a data source of Spark's, for batches and for streams.

    register(spark)
    spark.read.format("page_shards").option("path", folder).load()
    spark.readStream.format("page_shards").option("path", folder).load()

Columns are url, host (of the url), html and shard (the file's name); a schema given to the reader
picks among them and other fields of the lines, and only those are parsed. Files are read by byte
ranges, which are partitions together up to `rangeBytes`. Filters on host by equality or a list and
on the start of url are taken over by the source: lines that can't pass aren't parsed. A stream's
offset is how far each file has been read, to the end of a line, so files may grow and be added.

Options: path (a file or folder on any file system that pyarrow knows), suffix (".json"),
rangeBytes (32 MB), mode ("failfast"; with "dropmalformed" lines that are no JSON objects of the
right types are left out).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.json
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?P<host>[^/?#]*)"
#: A line whose first field is a url without escapes.
_URL_FIRST = re.compile(rb'\s*\{\s*"url"\s*:\s*"([^"\\]*)"')
_BLOCK = 8 << 20
_MADE = ("host", "shard")


@dataclass(frozen=True)
class Range:
    """The lines that begin in these bytes of a file."""

    path: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    parts: tuple[Range, ...]


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and the path in it, of a URI or an absolute local path."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path):
        return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


def shards(path: str, suffix: str) -> list[tuple[str, int]]:
    """Path and size of each file with the suffix, in order of name; hidden ones are none. A path that is missing has none yet."""
    system, place = file_system(path)
    info = system.get_file_info(place)
    if info.type == pyarrow.fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(pyarrow.fs.FileSelector(place, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(place) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(suffix) and not hidden(f.path))


def planned(spans: Iterable[Range], most: int) -> list[Ranges]:
    """The spans in parts of at most `most` bytes, small ones together."""
    out, held, size = [], [], 0
    for s in spans:
        for at in range(s.start, s.end, most):
            part = Range(s.path, at, min(at + most, s.end))
            if held and size + part.end - part.start > most:
                out.append(Ranges(tuple(held)))
                held, size = [], 0
            held.append(part)
            size += part.end - part.start
    return [*out, Ranges(tuple(held))] if held else out


def blocks(file: pa.NativeFile, start: int, end: int, size: int = _BLOCK) -> Iterator[bytes]:
    """The lines that begin in [start, end), whole, some at a time."""
    at, rest = start, b""
    if start:  # a line that begins before is another range's
        file.seek(start - 1)
        at = start - 1
        while piece := file.read(size):
            cut = piece.find(b"\n")
            at += len(piece) if cut < 0 else cut + 1
            if cut >= 0:
                break
        else:
            return
    file.seek(at)
    begin = at  # where rest begins
    while begin < end and (piece := file.read(size)):
        rest += piece
        if begin + len(rest) >= end:  # the last line may end beyond
            stop = rest.find(b"\n", end - 1 - begin)
        else:
            stop = rest.rfind(b"\n")
        if stop >= 0:
            yield rest[: stop + 1]
            begin, rest = begin + stop + 1, rest[stop + 1 :]
    if rest and begin < end:
        yield rest


class Lines:
    """Parses blocks of lines into batches with the columns of a schema, those lines only that pass the filters."""

    def __init__(self, schema: StructType, filters: list[Filter], drop_malformed: bool):
        self.schema, self.drop_malformed = to_arrow_schema(schema), drop_malformed
        self.hosts: list[set[str]] = [{f.value} if isinstance(f, EqualTo) else set(f.value) for f in filters if not isinstance(f, StringStartsWith)]
        self.starts = [f.value for f in filters if isinstance(f, StringStartsWith)]
        names = [n for n in self.schema.names if n not in _MADE]
        if "url" not in names and ("host" in self.schema.names or self.hosts or self.starts):
            names.append("url")
        fields = [self.schema.field(n) if n in self.schema.names else pa.field(n, pa.string()) for n in names]
        self.parsed = pa.schema(fields)
        # What a line that passes holds as it is, unless its characters are escaped.
        self.needles = [re.compile(b"|".join(re.escape(v.encode()) for v in sorted(any_of))) for any_of in self.hosts if any_of]
        self.needles += [re.compile(re.escape(v.encode())) for v in self.starts]

    def _may_pass(self, line: bytes) -> bool:
        """False only if the line's url can't pass: it has no escapes and lacks what a filter asks for."""
        if first := _URL_FIRST.match(line):
            return all(n.search(first[1]) for n in self.needles)
        return b"\\" in line or all(n.search(line) for n in self.needles)

    def _read(self, block: bytes) -> pa.Table:
        options = pyarrow.json.ParseOptions(explicit_schema=self.parsed, unexpected_field_behavior="ignore")
        return pyarrow.json.read_json(io.BytesIO(block), pyarrow.json.ReadOptions(use_threads=False, block_size=len(block) + 1), options)

    def _whole(self, lines: list[bytes]) -> pa.Table:
        if not lines:
            return self.parsed.empty_table()
        try:
            return self._read(b"\n".join(lines))
        except pa.ArrowInvalid:
            if not self.drop_malformed:
                raise
        if len(lines) == 1:
            return self.parsed.empty_table()
        half = len(lines) // 2
        return pa.concat_tables([self._whole(lines[:half]), self._whole(lines[half:])])

    def batches(self, block: bytes, shard: str) -> Iterator[pa.RecordBatch]:
        lines = [x for x in block.split(b"\n") if x and not x.isspace()]
        if self.needles:
            lines = [x for x in lines if self._may_pass(x)]
        t = self._whole(lines)
        host = pc.struct_field(pc.extract_regex(t["url"], _HOST), "host") if "url" in t.schema.names else None
        if host is not None:
            host = pc.if_else(pc.is_null(t["url"]), pa.scalar(None, pa.string()), pc.fill_null(host, ""))  # a url without host has an empty one
        keep = None
        for passes in [*(pc.is_in(host, pa.array(sorted(any_of), pa.string())) for any_of in self.hosts), *(pc.fill_null(pc.starts_with(t["url"], s), False) for s in self.starts)]:
            keep = passes if keep is None else pc.and_(keep, passes)
        made = {"host": host, "shard": pa.chunked_array([pa.array([shard] * t.num_rows, pa.string())])}
        out = pa.table([(made[f.name] if f.name in _MADE else t[f.name]).cast(f.type) for f in self.schema], schema=self.schema)
        yield from (out if keep is None else out.filter(keep)).to_batches(max_chunksize=4096)


def _taken_over(f: Filter) -> bool:
    if isinstance(f, (EqualTo, In)) and f.attribute == ("host",):
        return all(isinstance(v, str) for v in ([f.value] if isinstance(f, EqualTo) else f.value))
    return isinstance(f, StringStartsWith) and f.attribute == ("url",)


class _Reads:
    """What batches and streams share: the lines of a partition."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.filters = schema, []
        self.path, self.suffix = options["path"], options.get("suffix", ".json")
        self.most = int(options.get("rangeBytes", 32 << 20))
        self.drop_malformed = options.get("mode", "failfast").lower() == "dropmalformed"

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        lines = Lines(self.schema, self.filters, self.drop_malformed)
        for part in partition.parts:
            with system.open_input_file(part.path) as file:
                for block in blocks(file, part.start, part.end):
                    yield from lines.batches(block, part.path.rpartition("/")[2])


class ShardReader(_Reads, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _taken_over(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        return planned((Range(p, 0, n) for p, n in shards(self.path, self.suffix) if n), self.most) or [Ranges(())]


class ShardStreamReader(_Reads, DataSourceStreamReader):
    """Offsets: how many bytes of each file are read."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = file_system(self.path)
        return {p: end for p, n in shards(self.path, self.suffix) if (end := _whole_lines(system, p, n))}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return planned((Range(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)), self.most)

    def commit(self, end: dict) -> None:
        """Nothing to do: what was read stays."""


def _whole_lines(system: pyarrow.fs.FileSystem, path: str, size: int, step: int = 1 << 16) -> int:
    """The end of the last whole line; what follows may still be written."""
    with system.open_input_file(path) as file:
        end = size
        while end:
            begin = max(0, end - step)
            file.seek(begin)
            if (at := file.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return 0


class PageShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_shards"

    def schema(self) -> str:
        return "url string, host string, html string, shard string"

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(schema, self.options)

    def streamReader(self, schema: StructType) -> ShardStreamReader:
        return ShardStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and have its filters offered to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageShards)
