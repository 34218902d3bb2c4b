"""Robots rules with a time to live on streams: each URL is judged by the rules in force when it was asked for.

Robots rows and URLs come in one stream, each with its event time, and late
within the watermark. A URL waits in state until the watermark has passed its
time, when a timer fires; by then every robots row that could count is there,
so the result is that of the batch (robots.snapshot as of that time) whatever
the order of arrival. Rules that no URL to come can need are dropped: of those
the watermark has passed only the latest stays, and that only while it lives.

A domain is one key. `salts` deals the URLs of each domain to so many keys, with
the domain's robots rows, few as they are, at each of them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import domain
from ..operators.robots import first_match, match_path, rule_table

_RULES = "array<struct<allow: boolean, path: string>>"
_OUT = "domain string, salt int, url string, at timestamp, rules string, crawl_delay double, fetched_at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def robots_events(fetched: DataFrame, agent: str = "*") -> DataFrame:
    """Robots rows (domain, status, body, fetched_at) as events: their rules are parsed once, here."""
    rows = fetched.select("domain", "status", "body", F.col("fetched_at").alias("at"))
    return rule_table(rows, agent, keep=["at"]).select("domain", "at", F.lit(None).cast("string").alias("url"), F.to_json("rules").alias("rules"), "crawl_delay")


def url_events(urls: DataFrame, time: str = "asked_at", url_col: str = "url") -> DataFrame:
    """URLs as events at the time they were asked for."""
    null = F.lit(None)
    return urls.select(domain(F.col(url_col)).alias("domain"), F.col(time).alias("at"), F.col(url_col).alias("url"), null.cast("string").alias("rules"), null.cast("double").alias("crawl_delay"))


class _InForce(StatefulProcessor):
    """State of a key: rules by the time they were fetched, and URLs that wait with their time; times in microseconds.

    One timer a key suffices: at the first time that waits. As it fires, all
    that the watermark has passed is judged, and the next timer is set.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rules = handle.getMapState("rules", "at bigint", "rules string, crawl_delay double")
        self.waiting = handle.getListState("waiting", "at bigint, url string")

    def _wake(self, at: int, after: int = -1) -> None:
        """A timer for the first millisecond that isn't before a time, if none is set as early; those up to `after` don't count, as they are about to go."""
        due = -(-at // 1000)
        if not any(after < t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked: list[tuple[int, str]] = []
        for part in rows:
            micros = part["at"].astype("int64") // {"ns": 1000, "us": 1}[part["at"].dt.unit]
            for at, url, said, delay in zip(micros, part["url"], part["rules"], part["crawl_delay"], strict=True):
                if url is None:
                    self.rules.updateValue((at,), (said, None if pd.isna(delay) else float(delay)))
                else:
                    asked.append((at, url))
        if asked:
            self.waiting.appendList(asked)
            self._wake(min(asked)[0])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        asked = sorted(self.waiting.get())
        due = bisect.bisect_right(asked, passed, key=lambda w: w[0])
        if due:
            if due < len(asked):
                self.waiting.put(asked[due:])
            else:
                self.waiting.clear()
        if due < len(asked):
            self._wake(asked[due][0], after=passed // 1000)
        rules = sorted((at, *said) for (at,), said in self.rules.iterator())
        out = []
        for at, url in asked[:due]:
            last = bisect.bisect_right(rules, at, key=lambda r: r[0]) - 1
            found = rules[last] if last >= 0 and rules[last][0] > at - self.ttl else (None, None, None)
            out.append((*key, url, at, *found[1:], found[0]))
        # What is to come is later than the watermark.
        old = [r[0] for r in rules if r[0] <= passed]
        for at in old:
            if at != old[-1] or at <= passed - self.ttl:
                self.rules.removeKey((at,))
        frame = pd.DataFrame(out, columns=["domain", "salt", "url", "at", "rules", "crawl_delay", "fetched_at"])
        for c in ("at", "fetched_at"):
            frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us", utc=True)
        yield frame

    def close(self) -> None:
        """Nothing is held beside the state."""


def rules_in_force(events: DataFrame, ttl_seconds: int = 3600, delay: str = "10 minutes", salts: int = 1) -> DataFrame:
    """url, at, allowed, crawl_delay and fetched_at (of the rules; null if none were in force) for each URL of the events.

    events: robots_events and url_events, unioned; rows later than the watermark
    allows are dropped. Without rules in force a URL is allowed. Of robots rows
    of a domain at one time the last to come counts. State is kept in RocksDB: state_in_rocksdb() sets that.
    """
    robots = F.col("url").isNull()
    dealt: Column = F.when(robots, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int")))
    keyed = events.withColumn("salt", F.explode(dealt)).withWatermark("at", delay)
    judged = keyed.groupBy("domain", "salt").transformWithStateInPandas(_InForce(ttl_seconds), _OUT, "Append", "EventTime")
    matched = judged.withColumns({"__path": match_path(F.col("url")), "__rules": F.from_json("rules", _RULES)})
    return matched.select("url", "at", first_match(F.col("__rules"), F.col("__path")).alias("allowed"), "crawl_delay", "fetched_at")


def state_in_rocksdb(spark: SparkSession) -> None:
    """What streams with state of this kind need."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
