"""From a log of fetches to result rows: routes, predicates, session statistics, the rows to export."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.html import PAGE_SCHEMA, extract, page_record
from ..options import OPTIONS
from .flatten import clean_record
from ..functions.urls import storage_key
from ..sources.shared import written
from .frontier import disposition, queue_counts, queue_stats
from .robots import can_fetch
from .store import latest

# What browsers don't load.
BLOCKED_DOMAINS = ["google-analytics.com", "googletagmanager.com", "facebook.com", "doubleclick.net", "analytics.", "tracker.", "ads."]


def is_success(status: Column, error: Column) -> Column:
    return (status >= 200) & (status < 300) & error.isNull()


def is_blocked(status: Column) -> Column:
    return status.isin(403, 429)


def needs_browser(status: Column, error: Column, content: Column) -> Column:
    return is_success(status, error) & (F.char_length(F.trim(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""))) < 500)


def blocks_resource(url: Column, resource_type: Column, *, images: bool = True, fonts: bool = True, media: bool = True, domains: list[str] | None = None) -> Column:
    """By type, or by a part of the URL."""
    kinds = [k for k, on in (("image", images), ("font", fonts), ("media", media)) if on]
    hit = resource_type.isin(*kinds) if kinds else F.lit(False)
    for part in BLOCKED_DOMAINS if domains is None else domains:
        hit = hit | F.contains(F.lower(url), F.lit(part))
    return hit


def route(status: Column, error: Column, content: Column) -> Column:
    """browser for good pages that need one and for blocked ones, http for good pages, else failed."""
    ok = is_success(status, error)
    return F.when(ok & detect.needs_browser_quick(content), "browser").when(ok, "http").when(is_blocked(status), "browser").otherwise("failed")


def process(urls: DataFrame, fetches: DataFrame, log: DataFrame | None = None, parser: Callable[[str], dict] = page_record, schema: str = PAGE_SCHEMA, clean: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """A result row for each url: held pages are parsed again, others come from the fetch log, those without a fetch fail.

    fetches: url, status_code, content, response_time, error; rendered, if
    there, is what a browser gave. Held pages have status 0 and time 0. Of
    several fetches of a URL one counts: a success before failures, then the
    lower status, the shorter time and the longer content.

    by: columns of urls, fetches and the log that tell visits of a URL apart;
    each takes only its own fetch and what the log has of it.
    """
    by = list(by)
    rendered = F.col("rendered") if "rendered" in fetches.columns else F.lit(None).cast("string")
    rows = urls.select("url", *by, storage_key(F.col("url")).alias("__key"))
    if log is not None:
        kept = latest(log, ["content"], by).where("op = 'S'").select(*by, F.col("url_hash").alias("__key"), F.col("content").alias("__held"), F.lit(True).alias("__is_held"))
        rows = rows.join(kept, [*by, "__key"], "left")
    else:
        rows = rows.withColumns({"__held": F.lit(None).cast("string"), "__is_held": F.lit(None).cast("boolean")})
    held = F.coalesce("__is_held", F.lit(False))
    named = [F.col(c).alias(f"__of_{c}") for c in by]
    fetched = fetches.select(*named, storage_key(F.col("url")).alias("__of_key"), F.col("url").alias("__url"), "status_code", "content", "response_time", "error", rendered.alias("rendered"))
    fetched = _one_each(fetched, [*(f"__of_{c}" for c in by), "__of_key"], "__url")
    # Fetches meet rows by the key of the store, by which the rows lie already; as an equality the URL would become a key too, and held pages would move once more.
    same = [*(F.col(c) == F.col(f"__of_{c}") for c in by), F.col("__key") == F.col("__of_key"), F.col("url") >= F.col("__url"), F.col("url") <= F.col("__url")]
    # Every row has its page and its fetch beside it, so that urls and the log are gone through once; held rows take no fetch.
    got = rows.join(fetched, [*same, ~held], "left")
    way = F.when(F.col("status_code").isNull(), "failed").otherwise(route(F.col("status_code"), F.col("error"), F.col("content")))
    got = got.withColumn("route", way)
    ok = F.coalesce(is_success(F.col("status_code"), F.col("error")) | ((F.col("route") == "browser") & F.col("rendered").isNotNull()), F.lit(False))
    body = F.when(F.col("route") == "browser", F.coalesce("rendered", "content")).otherwise(F.col("content"))
    error = F.when(ok, F.lit(None).cast("string")).otherwise(F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")), F.lit("not fetched")))
    both = got.select(
        "url",
        (held | ok).alias("success"),
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        F.when(held, F.col("__held")).otherwise(body).alias("content"),
        F.when(~held, error).alias("error"),
        F.coalesce("response_time", F.lit(0.0)).alias("response_time"),
        F.when(held, "cache").otherwise(F.col("route")).alias("route"),
    )
    parsed = both.withColumn("data", F.when(F.col("success"), extract(F.when(F.col("success"), F.col("content")), parser, schema)))
    if clean:
        parsed = clean_record(parsed, [*parsed.select("data.*").columns, "data"])
    return parsed


def _one_each(fetches: DataFrame, keys: list[str], url: str) -> DataFrame:
    """The fetch of each URL under the keys that counts; rows come by the keys, so that the join with them needs no exchange of its own."""
    first = F.struct(is_success(F.col("status_code"), F.col("error")), -F.col("status_code"), -F.col("response_time"), F.octet_length("content"), F.xxhash64("content", "rendered", "error"))
    rest = [c for c in fetches.columns if c not in (*keys, url)]
    return fetches.repartition(*keys).groupBy(*keys, url).agg(F.max_by(F.struct(*rest), first).alias("__f")).select(*keys, url, *(F.col(f"__f.{c}").alias(c) for c in rest))


def blocked_by_robots(urls: DataFrame) -> DataFrame:
    """The failure rows of URLs that may not be fetched."""
    return urls.select("url", F.lit(False).alias("success"), F.lit(0).alias("status_code"), F.lit("Blocked by robots.txt").alias("error"), F.lit(0.0).alias("response_time"))


def _judged(urls: DataFrame, rules: DataFrame | None, max_size: int | None, seen: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Each URL offered (seq, url, those of by) with its disposition. What robots rules say is written down, since the frontier looks at it more than once."""
    kept = [*dict.fromkeys(["seq", "url", *by])]
    offered = written(can_fetch(urls, rules).select(*kept, "allowed"), "offered") if rules is not None else urls.select(*kept, F.lit(True).alias("allowed"))
    return disposition(offered, max_size, seen)


def batch_run(urls: DataFrame, fetches: DataFrame, rules: DataFrame | None = None, *, log: DataFrame | None = None, seen: DataFrame | None = None, max_size: int | None = OPTIONS.queue_size, popped: int | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Results of the URLs (seq, url) that the frontier takes, and one row of queue statistics.

    URLs that robots rules deny, repeats and those beyond max_size are counted
    in the statistics and have no result. All that is taken is processed,
    unless popped says how many were. by as in process(), over columns of urls.
    """
    judged = _judged(urls, rules, max_size, seen, by)
    if popped is None:
        stats = queue_stats(judged, max_size).withColumns({"total_processed": F.col("total_added"), "current_size": F.lit(0).cast("long")})
    else:
        stats = queue_stats(judged, max_size, popped)
    return process(judged.where("disposition = 'added'").select("url", *by), fetches, log, by=by), stats


class RunMetrics:
    """The statistics of a run, gathered while its results are read for the first time; all rows must be."""

    def __init__(self):
        self.of_queue, self.of_session = Observation(), Observation()

    def queue(self) -> dict:
        return self.of_queue.get

    def session(self) -> dict:
        return with_rates(self.of_session.get)


def observed_run(urls: DataFrame, fetches: DataFrame, rules: DataFrame | None = None, *, log: DataFrame | None = None, seen: DataFrame | None = None, max_size: int | None = OPTIONS.queue_size, by: Sequence[str] = ()) -> tuple[DataFrame, RunMetrics]:
    """Like batch_run, with statistics that the job which exports the results gives as well.

    The first action on the results gives the figures, so it must be the one that takes all rows.
    """
    metrics = RunMetrics()
    judged = _judged(urls, rules, max_size, seen, by).observe(metrics.of_queue, *queue_counts())
    results = process(judged.where("disposition = 'added'").select("url", *by), fetches, log, by=by)
    return results.observe(metrics.of_session, *session_counts()), metrics


def single_runs(urls: DataFrame, fetches: DataFrame, rules: DataFrame, log: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A result for each URL as if it were run alone: those that robots rules deny fail without a fetch. by as in process()."""
    judged = can_fetch(urls, rules)
    return process(judged.where("allowed").select("url", *by), fetches, log, by=by).unionByName(blocked_by_robots(judged.where("not allowed")), allowMissingColumns=True)


def session_counts() -> list[Column]:
    """URLs processed, successes, bytes and characters, fetches by route, as aggregates over results; held pages count as neither route."""
    total, good = F.count("*"), F.count_if("success")
    fetched = F.col("success") & (F.col("route") != "cache")
    return [
        total.alias("urls_processed"),
        good.alias("urls_successful"),
        (total - good).alias("urls_failed"),
        F.coalesce(F.sum(F.when(fetched, F.octet_length("content"))), F.lit(0)).alias("bytes_downloaded"),
        F.coalesce(F.sum(F.when(fetched, F.char_length("content"))), F.lit(0)).alias("chars_downloaded"),
        F.count_if(F.col("route") == "browser").alias("browser_fetches"),
        F.count_if(F.col("route") == "http").alias("http_fetches"),
    ]


def with_rates(counts: dict) -> dict:
    """Counts of a session with the share of successes in per cent."""
    n = counts["urls_processed"]
    return counts | {"success_rate": counts["urls_successful"] / n * 100 if n else 0.0}


def session_stats(results: DataFrame) -> DataFrame:
    """One row of them, with the share of successes."""
    n = F.col("urls_processed")
    return results.agg(*session_counts()).withColumn("success_rate", F.when(n == 0, F.lit(0.0)).otherwise(F.col("urls_successful") / n * 100))


def combined_stats(results: DataFrame, queue: DataFrame, status: str = "completed") -> DataFrame:
    """One row of structs: session and queue statistics, with the status."""
    # Both sides have one row.
    return session_stats(results).select(F.struct("*").alias("session")).join(F.broadcast(queue.select(F.struct("*").alias("queue")))).withColumn("status", F.lit(status))


def export_rows(results: DataFrame) -> DataFrame:
    """url, success, status_code, error, response_time and the fields of data; those win over columns of the same name."""
    data = results.select("data.*").columns
    base = [c for c in ("url", "success", "status_code", "error", "response_time") if c not in data]
    return results.select(*base, "data.*")
