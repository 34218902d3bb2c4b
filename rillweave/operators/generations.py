"""The raw-page store on disk: generations of log rows in buckets, named by manifests, compacted now and then.

    data/gen=<id>/bucket=<k>/...   rows of one save, delete or compaction; never changed
    manifests/<version>.json     which generations count, and how many buckets keys are dealt into

A change writes its generation first and then publishes the next manifest, under
a name that only one writer can take. What breaks off before that is not seen
and goes with vacuum(); readers keep the manifest that they began with. A writer
that finds its version taken looks again: saves and deletes go after what came
meanwhile, a compaction replaces exactly the generations that it has read.

Rows are read latest wins, as in store.py. The bucket is a partition column and rows are in
order of the key within files, so the plan of a point read has one bucket and the row groups
that can hold the key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import storage_key
from . import store

SCHEMA = "url string, url_hash string, filename string, content_type string, stored_at double, size_bytes bigint, status_code int, content string, op string, gen string, bucket int"


@dataclass(frozen=True)
class Manifest:
    """compacted: the first generation has each key once."""

    version: int
    n_buckets: int
    generations: tuple[str, ...] = ()
    compacted: bool = False


def bucket_of(key: Column, n_buckets: int) -> Column:
    return F.pmod(F.crc32(key), F.lit(n_buckets)).cast("int")


def in_buckets(rows: DataFrame, n_buckets: int) -> DataFrame:
    """rows with their bucket, those of a bucket together and in order of the key; Spark splits buckets that are large and joins small ones in a task."""
    dealt = rows.withColumn("bucket", bucket_of(F.col("url_hash"), n_buckets)).hint("rebalance", "bucket")
    return dealt.sortWithinPartitions("bucket", "url_hash")


class PageStore:
    """A store at a path on any file system that Spark writes to. n_buckets counts when the store is new; task_bytes bounds what a task of a compaction reads."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 256, task_bytes: int = 256 << 20):
        self.spark, self.path, self.n_buckets, self.task_bytes = spark, path.rstrip("/"), n_buckets, task_bytes
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._jvm.Path(self.path).getFileSystem(self._conf)

    # Files and manifests

    def _at(self, *names: str):
        return self._jvm.Path("/".join([self.path, *names]))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._system.listStatus(at)) if self._system.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or the one of a version; a new store has version 0 and no generations."""
        have = self.versions()
        if version is None:
            version = max(have, default=0)
        if version == 0:
            return Manifest(0, self.n_buckets)
        stream = self._system.open(self._at("manifests", f"{version:012d}.json"))
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(found["version"], found["n_buckets"], tuple(found["generations"]), found["compacted"])

    def _publish(self, manifest: Manifest) -> bool:
        """Whether this manifest became the one of its version; False if another writer was first."""
        draft, final = self._at("manifests", f"_{uuid.uuid4().hex}"), self._at("manifests", f"{manifest.version:012d}.json")
        out = self._system.create(draft, True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        files = self._jvm.FileContext.getFileContext(draft.toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 0)
        try:
            files.rename(draft, final, never_over)
        except Py4JJavaError as e:
            self._system.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _change(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Publish what change makes of the latest manifest, again and again until no other writer comes between."""
        while True:
            now = self.manifest()
            after = replace(change(now), version=now.version + 1)
            if self._publish(after):
                return after

    def _write(self, rows: DataFrame) -> str:
        """A new generation of rows that lie by bucket."""
        name = f"gen={uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        return name

    # Changes

    def _append(self, rows: DataFrame) -> Manifest:
        name = self._write(in_buckets(rows, self.manifest().n_buckets))
        return self._change(lambda m: replace(m, generations=(*m.generations, name)))

    def save(self, pages: DataFrame) -> Manifest:
        """Save url, content and stored_at, and content_type and status_code if there; a generation of its own."""
        return self._append(store.save_rows(pages))

    def delete(self, urls: DataFrame) -> Manifest:
        """Delete each url as of its stored_at."""
        return self._append(store.delete_rows(urls))

    def compact(self, forget_deletes_before: float | None = None) -> Manifest:
        """Make one generation of all there are, with the latest row of each key.

        Deletes stay, without content, so that a save which comes late with an
        earlier time doesn't bring a page back; those before a time go if one is given.
        """
        before = self.manifest()
        if not before.generations:
            return before
        # One exchange by bucket and slice of it serves the aggregate by key and the files.
        slice_ = F.pmod(F.xxhash64("url_hash"), F.lit(self._slices(before))).cast("int")
        dealt = self._rows(before).drop("gen").withColumn("slice", slice_).repartition("bucket", "slice")
        rows = store.latest(dealt, [*store.META, "content"], by=["bucket", "slice"])
        if forget_deletes_before is not None:
            rows = rows.where((F.col("op") == "S") | (F.col("stored_at") >= forget_deletes_before))
        name = self._write(rows.drop("slice").sortWithinPartitions("bucket", "url_hash"))

        def swap(now: Manifest) -> Manifest:
            if now.generations[: len(before.generations)] != before.generations:
                raise RuntimeError("the store was compacted or cleared meanwhile")
            return replace(now, generations=(name, *now.generations[len(before.generations) :]), compacted=True)

        return self._change(swap)

    def _slices(self, manifest: Manifest) -> int:
        """Into how many parts a bucket goes, so that a task has no more than `task_bytes` of files."""
        size = sum(self._system.getContentSummary(self._at("data", g)).getLength() for g in manifest.generations)
        return max(1, -(-size // (manifest.n_buckets * self.task_bytes)))

    def clear(self) -> int:
        """Empty the store; how many pages it held."""
        n = self.list_all().count()
        self._change(lambda m: replace(m, generations=(), compacted=False))
        return n

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Delete generations that none of the last `keep` manifests names, and older manifests; nothing younger than older_than seconds, as it may be about to be published. The names that went."""
        versions = self.versions()
        kept = versions[-keep:]
        live = {g for v in kept for g in self.manifest(v).generations}
        old = lambda p: self._system.getFileStatus(p).getModificationTime() / 1000 <= time.time() - older_than
        gone = [("manifests", f"{v:012d}.json") for v in versions if v not in kept]
        gone += [("data", n) for n in self._names("data") if n not in live]
        gone += [("manifests", n) for n in self._names("manifests") if n.startswith("_")]
        gone = [g for g in gone if old(self._at(*g))]
        for g in gone:
            self._system.delete(self._at(*g), True)
        return [name for _, name in gone]

    # Reads

    def _rows(self, manifest: Manifest) -> DataFrame:
        if not manifest.generations:
            return self.spark.createDataFrame([], SCHEMA)
        # Only the folders of these generations are listed; both partition columns come from their names.
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{g}" for g in manifest.generations))

    def log(self, version: int | None = None) -> DataFrame:
        """The rows that count, of the latest version or an earlier one that vacuum has left."""
        return self._rows(self.manifest(version))

    def current(self, version: int | None = None, content: bool = True) -> DataFrame:
        """The pages held. Straight after a compaction each key is there once, and nothing is shuffled."""
        now = self.manifest(version)
        if now.compacted and len(now.generations) == 1:
            return self._rows(now).where("op = 'S'").select(*store.META, *["content"] * content)
        return store.current(self._rows(now), content)

    def _of(self, url: str) -> DataFrame:
        """The rows of a URL: a constant bucket, which prunes folders, and a constant key."""
        now, key = self.manifest(), storage_key(F.lit(url))
        return self._rows(now).where((F.col("bucket") == bucket_of(key, now.n_buckets)) & (F.col("url_hash") == key))

    def load(self, url: str) -> DataFrame:
        """The content held for a URL; no row if there is none."""
        return store.current(self._of(url)).select("content")

    def metadata(self, url: str) -> DataFrame:
        return store.current(self._of(url), content=False)

    def load_many(self, urls: DataFrame) -> DataFrame:
        """urls that are held, with content and stored_at; buckets without any of them are pruned as the join runs."""
        now = self.manifest()
        asked = urls.withColumn("__key", storage_key(F.col("url"))).withColumn("__bucket", bucket_of(F.col("__key"), now.n_buckets))
        rows, keys = self._rows(now), asked.select("__key", "__bucket").distinct()
        held = store.current(rows.join(keys, (rows.bucket == F.col("__bucket")) & (rows.url_hash == F.col("__key"))).drop("__key", "__bucket"))
        return asked.join(held.select(F.col("url_hash").alias("__key"), "content", "stored_at"), "__key").drop("__key", "__bucket")

    def list_all(self, version: int | None = None) -> DataFrame:
        return self.current(version, content=False)

    def stats(self) -> DataFrame:
        return store.stats(self.log())
