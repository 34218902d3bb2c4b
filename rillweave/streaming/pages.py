"""Streams: pages to cleaned records without repeats, and a token bucket per domain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.html import extract
from ..functions.urls import dedup_key, domain
from ..operators.flatten import clean_record


def parsed_pages(stream: DataFrame, time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Records of a stream of url, html; repeats of a URL are dropped, within the watermark if there is a time column."""
    keyed = stream.withColumn("dedup_key", dedup_key(F.col("url")))
    if time:
        keyed = keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["dedup_key"])
    else:
        keyed = keyed.dropDuplicates(["dedup_key"])
    data = keyed.withColumn("data", extract(F.col("html"))).drop("html")
    return clean_record(data, ["data", "title", "description", "h1", "text_preview"])


def host_windows(stream: DataFrame, time: str = "ts", size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Pages and bytes per host and window of event time."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), domain(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"), F.sum(F.octet_length("html")).alias("n_bytes"))


def admitted(stream: DataFrame, key: str = "domain", time: str = "ts", order: str = "seq", *, max_tokens: int = 5, refill_rate: float = 0.5) -> DataFrame:
    """(key, order, admitted) of a stream of requests (time: seconds as double); a bucket's tokens live in state."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(max_tokens), None)
        rows = pd.concat(list(parts)).sort_values([time, order])
        out = []
        for t, o in zip(rows[time], rows[order], strict=True):
            tokens = min(float(max_tokens), tokens + max(0.0, t - last if last is not None else 0.0) * refill_rate)
            last = t if last is None else max(last, t)
            ok = tokens >= 1
            tokens -= ok
            out.append((name[0], o, ok))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=[key, order, "admitted"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} long, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
