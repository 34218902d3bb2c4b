"""The store of generations: what breaks off, what comes between, what a plan reads, what stays."""

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from rillweave.operators import store
from rillweave.operators.generations import PageStore, bucket_of


@pytest.fixture
def held(spark, tmp_path):
    return PageStore(spark, f"file://{tmp_path}/store", n_buckets=8)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, content string, stored_at double")


def urls(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, stored_at double")


def content(held, version=None):
    found = {r.url: r.content for r in held.current(version).collect()}
    assert found == {r.url: r.content for r in store.current(held.log(version)).collect()}
    return found


def test_a_history_reads_the_same_before_and_after_compaction(spark, held):
    draw, want, plain = random.Random(2), {}, []
    for step in range(8):
        batch = {f"u{draw.randint(0, 30)}": (draw.choice(["c", "long content é"]) + str(step), draw.randint(0, 40) + step / 10) for _ in range(12)}
        gone = step in (2, 5)
        if gone:
            held.delete(urls(spark, *((u, t) for u, (_, t) in batch.items())))
        else:
            held.save(pages(spark, *((u, c, t) for u, (c, t) in batch.items())))
        plain += [(t, not gone, u, c) for u, (c, t) in batch.items()]
        if step in (3, 6):
            before = content(held)
            held.compact()
            assert content(held) == before and len(held.manifest().generations) == 1
    for t, saved, u, c in sorted(plain):
        want[u] = c if saved else None
    assert content(held) == {u: c for u, c in want.items() if c is not None}
    assert held.list_all().count() == held.stats().first().total_files == len(content(held))


def test_compaction_has_one_exchange_and_slices_large_buckets(spark, tmp_path):
    held = PageStore(spark, f"file://{tmp_path}/store", n_buckets=4, task_bytes=2000)
    rows = [(f"u{i % 150}", "x" * (i % 50), float(i)) for i in range(300)]
    held.save(pages(spark, *rows[:150]))
    held.save(pages(spark, *rows[150:]))
    assert held._slices(held.manifest()) > 1
    held.compact()
    assert len(content(held)) == 150 and held.manifest().compacted
    plan = held.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    held.save(pages(spark, ("u1", "newer", 1e9)))
    assert content(held)["u1"] == "newer" and len(content(held)) == 150


def test_nothing_is_lost_when_a_step_breaks_off(spark, held, monkeypatch):
    held.save(pages(spark, ("a", "1", 1.0), ("b", "1", 1.0)))
    held.save(pages(spark, ("a", "2", 2.0)))

    def broken(self, manifest):
        raise OSError("the writer is gone")

    for step in (lambda: held.save(pages(spark, ("a", "3", 3.0))), lambda: held.delete(urls(spark, ("b", 3.0))), held.compact, held.clear):
        with monkeypatch.context() as m:
            m.setattr(PageStore, "_publish", broken)
            with pytest.raises(OSError, match="gone"):
                step()
        assert content(held) == {"a": "2", "b": "1"} and held.manifest().version == 2
    assert len(held._names("data")) == 5  # the rows of a save, a delete and a compaction that nobody sees
    assert held.vacuum() == []  # too young to tell from one that is about to be published
    assert len(held.vacuum(older_than=0)) == 4 and len(held._names("data")) == 2
    assert content(held) == {"a": "2", "b": "1"}


def test_a_writer_that_comes_between_is_kept(spark, held, tmp_path, monkeypatch):
    other = PageStore(spark, f"file://{tmp_path}/store")
    held.save(pages(spark, ("a", "1", 1.0)))
    write = PageStore._write

    def slow(self, rows):
        name = write(self, rows)
        monkeypatch.setattr(PageStore, "_write", write)
        other.save(pages(spark, ("b", "2", 2.0)))
        return name

    monkeypatch.setattr(PageStore, "_write", slow)
    held.compact()
    assert content(held) == {"a": "1", "b": "2"} and len(held.manifest().generations) == 2 and held.manifest().n_buckets == 8

    def slow_again(self, rows):
        name = write(self, rows)
        monkeypatch.setattr(PageStore, "_write", write)
        other.compact()
        return name

    monkeypatch.setattr(PageStore, "_write", slow_again)
    with pytest.raises(RuntimeError, match="meanwhile"):
        held.compact()
    assert content(held) == {"a": "1", "b": "2"}


def test_saves_at_once_all_count(spark, held):
    together = [threading.Thread(target=lambda i=i: PageStore(spark, held.path).save(pages(spark, (f"u{i}", str(i), 1.0)))) for i in range(4)]
    for t in together:
        t.start()
    for t in together:
        t.join()
    assert content(held) == {f"u{i}": str(i) for i in range(4)} and held.manifest().version == 4


def test_a_late_save_does_not_bring_back_what_was_deleted(spark, held):
    held.save(pages(spark, ("a", "1", 1.0)))
    held.delete(urls(spark, ("a", 5.0)))
    held.compact()
    held.save(pages(spark, ("a", "late", 3.0)))
    assert content(held) == {}
    held.compact(forget_deletes_before=6.0)
    assert held.log().count() == 0
    held.save(pages(spark, ("a", "new", 2.0)))
    assert content(held) == {"a": "new"}


def test_a_point_read_has_one_bucket_in_its_plan(spark, held):
    held.save(pages(spark, *((f"http://h/{i}", f"c{i}", 1.0) for i in range(200))))
    held.save(pages(spark, *((f"http://h/{i}", f"d{i}", 2.0) for i in range(0, 200, 2))))
    for url, want in (("http://h/8", "d8"), ("http://h/9", "c9")):
        got = held.load(url)
        assert [r.content for r in got.collect()] == [want]
        number = spark.range(1).select(bucket_of(store.storage_key(F.lit(url)), 8)).first()[0]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {number}\)", plan) and "EqualTo(url_hash," in plan
        files = {r[0] for r in held._of(url).select(F.input_file_name()).collect()}
        assert all(f"/bucket={number}/" in f for f in files) and len(files) == 2 - int(url[-1]) % 2
    held.compact()
    assert {r[0].split("/")[-3] for r in held._of("http://h/8").select(F.input_file_name()).collect()} == set(held.manifest().generations)
    assert held.load("http://h/none").collect() == [] and held.metadata("http://h/8").first().size_bytes == 2


def test_many_points_and_earlier_versions(spark, held):
    held.save(pages(spark, ("a", "1", 1.0), ("b", "1", 1.0)))
    first = held.manifest().version
    held.delete(urls(spark, ("a", 2.0)))
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "none")], "n int, url string")
    assert sorted((r.n, r.content) for r in held.load_many(asked).collect()) == [(2, "1"), (3, "1")]
    assert content(held, first) == {"a": "1", "b": "1"} and content(held, 0) == {}
    assert held.clear() == 1 and content(held) == {} and content(held, first) == {"a": "1", "b": "1"}


def test_a_store_that_tells_visits_apart_holds_each(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "a", 1.0), (2, "u", "b", 1.0), (2, "u", "bb", 2.0), (3, "v", "c", 1.0)], "page_id long, url string, content string, stored_at double")
    gone = spark.createDataFrame([(1, "u", 3.0)], "page_id long, url string, stored_at double")
    for by, want in (("page_id bigint", [("u", 2), ("v", 1)]), ("", [("v", 1)])):
        held = store.RawStore(spark, f"file://{tmp_path}/raw{len(by)}", by)
        assert held.list_all().count() == 0
        held.save(rows)
        held.delete(gone)
        assert sorted((r.url, r.size_bytes) for r in held.list_all().collect()) == want
        assert held.clear() == len(want) and held.list_all().count() == 0


@pytest.mark.parametrize("what", ["current", "stats", "generations", "point reads"])
def test_ties_are_settled_by_the_rows_and_not_by_their_order(spark, tmp_path, what):
    rows = [(f"u{i}", f"{c}{i % 7}é", 1.0, kind, status) for i in range(40) for c in "abcd" for kind, status in (("html", 200), ("json", 203))]
    got = []
    for k, order in enumerate((rows, rows[::-1])):
        saved = spark.createDataFrame(order, "url string, content string, stored_at double, content_type string, status_code int").coalesce(1)
        log = store.save_rows(saved)
        held = PageStore(spark, f"file://{tmp_path}/{k}", n_buckets=2)
        if what in ("generations", "point reads"):
            held.save(saved.where("content < 'c'"))
            held.save(saved.where("content >= 'c'"))
        if what == "generations":
            held.compact()
        asked = saved.select("url").distinct()
        found = {"current": lambda: store.current(log), "stats": lambda: store.current(log, content=False), "generations": lambda: held.current(), "point reads": lambda: held.load_many(asked)}[what]()
        got.append(sorted(map(repr, found.collect())))
        if what == "current":
            assert sorted(map(repr, found.select(*store.META).collect())) == sorted(map(repr, store.current(log, content=False).collect()))
    assert got[0] == got[1] and len(got[0]) == 40
