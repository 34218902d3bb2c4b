"""Rules in force on a stream against the batch, with rows out of order and late."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rillweave.operators import robots
from rillweave.streaming import robots as stream

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
BODIES = [None, "User-agent: *\nDisallow: /p\nCrawl-delay: 2", "User-agent: *\nAllow: /p/ok\nDisallow: /p", "User-agent: *\nDisallow: /", "User-agent: *\nDisallow:"]


def run(spark, batches, tmp_path, **options):
    """batches: lists of (minute, domain, url, status, body), a file and a micro-batch each."""
    stream.state_in_rocksdb(spark)
    kinds = "at timestamp, domain string, url string, status int, body string"
    for rows in batches:
        made = [(START + datetime.timedelta(minutes=m), d, u, s, b) for m, d, u, s, b in rows]
        spark.createDataFrame(made, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events = stream.robots_events(read.where("url is null").withColumnRenamed("at", "fetched_at")).unionByName(stream.url_events(read.where("url is not null").withColumnRenamed("at", "asked_at")))
    judged = stream.rules_in_force(events, **options)
    asked = judged.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    asked.awaitTermination()
    return sorted((r.url, r.at, r.allowed, r.crawl_delay, r.fetched_at) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def batch(spark, rows, ttl):
    """Each URL against the snapshot as of its time."""
    out = []
    fetched = spark.createDataFrame([(d, s, b, START + datetime.timedelta(minutes=m)) for m, d, u, s, b in rows if u is None], "domain string, status int, body string, fetched_at timestamp")
    for m, _, u, *_ in (r for r in rows if r[2] is not None):
        at = START + datetime.timedelta(minutes=m)
        snap = robots.snapshot(fetched, f"timestamp_seconds({int(at.timestamp())})", ttl)
        got = robots.can_fetch(spark.createDataFrame([(u,)], "url string"), robots.rule_table(snap)).first()
        out.append((u, at.replace(tzinfo=None), got.allowed, got.crawl_delay))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 2, 3])
def test_stream_equals_batch_whatever_the_order(spark, tmp_path, salts):
    draw, rows = random.Random(salts), []
    for m in range(0, 200, 9):
        rows.append((m + draw.randint(0, 5), f"h{draw.randint(0, 1)}", None, draw.choice([200, 200, 200, 404, 500]), draw.choice(BODIES)))
    times = {(r[0], r[1]) for r in rows}
    rows = [next(r for r in rows if (r[0], r[1]) == t) for t in sorted(times)]
    n_rules = len(rows)
    rows += [(m, f"h{m % 3}", f"http://h{m % 3}/{draw.choice(['p', 'p/ok', 'x'])}?{m}", None, None) for m in draw.sample(range(200), 14)]
    # Up to 20 minutes out of order, which the watermark of 30 allows.
    arrived = sorted(rows, key=lambda r: r[0] + draw.uniform(0, 20))
    size = len(arrived) if salts == 2 else 8  # all at once, so that all timers fire in one batch
    batches = [arrived[i : i + size] for i in range(0, len(arrived), size)] + [[(10_000, "end", None, 200, None)]]
    got = run(spark, batches, tmp_path, ttl_seconds=1800, delay="30 minutes", salts=salts)
    want = batch(spark, rows, 1800)
    assert [g[:4] for g in sorted(got, key=repr)] == want and len(want) == 14 and n_rules > 10
    assert len({g[2] for g in got}) == 2 and any(g[4] is None for g in got)


def test_rows_beyond_the_watermark_are_dropped_and_rules_expire(spark, tmp_path):
    deny = "User-agent: *\nDisallow: /"
    batches = [
        [(0, "h", None, 200, deny), (10, "h", "http://h/live", None, None)],
        [(100, "h", "http://h/expired", None, None)],
        [(200, "x", None, 200, None)],
        [(5, "h", "http://h/late", None, None), (201, "h", None, 200, deny)],
        [(202, "h", "http://h/again", None, None), (202, "h", "http://h/again", None, None), (400, "x", None, 200, None)],
        [(600, "x", None, 200, None)],
    ]
    got = run(spark, batches, tmp_path, ttl_seconds=3600, delay="5 minutes")
    assert [(u, allowed) for u, _, allowed, *_ in got] == [("http://h/again", False), ("http://h/again", False), ("http://h/expired", True), ("http://h/live", False)]
