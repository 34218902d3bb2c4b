"""Politeness per domain and health per proxy, folded over logs.

Whether a request is admitted depends on all those before it, so a key's log is
read in order by one task. It is never gathered: Spark sorts the partition,
spilling where it must, and the fold holds one state and one batch. Health
is made of parts that can be joined, so a hot proxy's log is dealt out by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import OPTIONS, Options

HALT_SECONDS = {"403": OPTIONS.halt_on_403, "429": OPTIONS.halt_on_429, "captcha": OPTIONS.halt_on_captcha}
OTHER_HALT = OPTIONS.halt_otherwise


def _in_order(events: DataFrame, key: str, time: str, order: str, others: list[str], start: tuple, step: Callable[..., tuple[tuple, tuple]], made: dict[str, str]) -> DataFrame:
    """key, time, order and what step(state, time, *others) makes of each row, the rows of a key in order, beginning from start.

    Rows of the same time and order come in order of the others; null keys are one key.
    """
    names, arrow = ["__key", "__time", "__order"], {"double": pa.float64(), "boolean": pa.bool_()}
    rows = events.select(F.col(key).alias(names[0]), F.col(time).cast("double").alias(names[1]), F.col(order).cast("long").alias(names[2]), *(F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(others)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for batch in batches:
            out = []
            for k, t, _, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (k,):
                    at, state = (k,), start
                state, got = step(state, t, *more)
                out.append(got)
            columns = zip(*out, strict=True) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, arrow[kind]) for c, kind in zip(columns, made.values(), strict=True))], names=[*names, *made])

    schema = f"__key {rows.schema['__key'].dataType.simpleString()}, __time double, __order long, " + ", ".join(f"{n} {kind}" for n, kind in made.items())
    folded = rows.repartition("__key").sortWithinPartitions(*rows.columns).mapInArrow(run, schema)
    return folded.select(F.col("__key").alias(key), F.col("__time").alias(time), F.col("__order").alias(order), *made)


def token_bucket(requests: DataFrame, key: str = "domain", time: str = "ts", order: str = "seq", *, max_tokens: int = OPTIONS.max_tokens, refill_rate: float = OPTIONS.refill_rate) -> DataFrame:
    """key, time, order, admitted and the tokens left for each request; a bucket starts full at its first one. time: seconds as double; at a null one no time has passed."""
    most = float(max_tokens)

    def step(state: tuple, t: float | None) -> tuple[tuple, tuple]:
        tokens, last = state
        if t is not None:
            tokens = min(most, tokens + (t - (t if last is None else last)) * refill_rate)
            last = t
        ok = tokens >= 1
        left = tokens - 1 if ok else tokens
        return (left, last), (ok, left)

    return _in_order(requests, key, time, order, [], (most, None), step, {"admitted": "boolean", "tokens": "double"})


def wait_for(tokens: Column, needed: int = 1, refill_rate: float = OPTIONS.refill_rate) -> Column:
    """Seconds until enough tokens are there."""
    return F.when(tokens >= needed, F.lit(0.0)).otherwise((needed - tokens) / refill_rate)


def chance(key: Column, seed: int) -> Column:
    """A number in [0, 1) that is the same for the same key and seed on any engine with SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def jitter(key: Column, least: float = OPTIONS.min_delay, most: float = OPTIONS.max_delay, seed: int = 7) -> Column:
    """A delay between the bounds that is the same for the same key."""
    return least + (most - least) * chance(key, seed)


def polite_delay(key: Column, strict: Column, options: Options = OPTIONS, seed: int = 7) -> Column:
    """The delay of a request: within the strict bounds where its domain is in strict mode (null: it isn't)."""
    bounds = jitter(key, options.strict_min_delay, options.strict_max_delay, seed)
    return F.when(F.coalesce(strict, F.lit(False)), bounds).otherwise(jitter(key, options.min_delay, options.max_delay, seed))


def with_strict_mode(requests: DataFrame, toggles: DataFrame, key: str = "domain", time: str = "ts", order: str = "seq") -> DataFrame:
    """requests with `strict`: what the last toggle (key, time, order, strict) of the domain before the request said, false if there is none.

    Both are logs in order of time, then order; a toggle goes before a request of equal time and order.
    """
    columns = [F.col(key).alias("__key"), F.col(time).alias("__time"), F.col(order).alias("__order")]
    asked = requests.select(*columns, F.lit(1).alias("__kind"), F.lit(None).cast("boolean").alias("__strict"), F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("__row"))
    turned = toggles.select(*columns, F.lit(0).alias("__kind"), F.coalesce("strict", F.lit(False)).alias("__strict"))
    log = asked.unionByName(turned, allowMissingColumns=True)
    upto = Window.partitionBy("__key").orderBy("__time", "__order", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mode = log.withColumn("__strict", F.coalesce(F.last("__strict", ignorenulls=True).over(upto), F.lit(False)))
    return mode.where("__kind = 1").select("__row.*", F.col("__strict").alias("strict"))


def halt_seconds(reason: Column) -> Column:
    out = F.lit(OTHER_HALT)
    for name, seconds in HALT_SECONDS.items():
        out = F.when(reason == name, F.lit(seconds)).otherwise(out)
    return out


def schedule(requests: DataFrame, key: str = "domain", time: str = "ts", order: str = "seq", *, max_tokens: int = OPTIONS.max_tokens, refill_rate: float = OPTIONS.refill_rate, delay: str = "delay", halt: str = "halt") -> DataFrame:
    """When each request goes out, for requests served in order: after a halt, with a token, and `delay` after the one before.

    delay: seconds to keep from the request before. halt: seconds that the
    answer to this request halts the domain, null for none. Time passed is
    counted when the request goes out. A request of null time goes out as soon
    as it may.
    """
    most = float(max_tokens)

    def step(state: tuple, t: float | None, wait: float | None, halted: float | None) -> tuple[tuple, tuple]:
        tokens, last, until = state
        since = (0.0 if t is None else t) if last is None else last
        free = max(since, until, since if t is None else t)
        tokens = min(most, tokens + (0.0 if last is None else free - last) * refill_rate)
        at = free + (0.0 if tokens >= 1 else (1 - tokens) / refill_rate)
        if last is not None and wait is not None:
            at = max(at, last + wait)
        left = min(most, tokens + (at - free) * refill_rate) - 1
        return (left, at, until if halted is None else at + halted), (at,)

    return _in_order(requests, key, time, order, [delay, halt], (most, None, 0.0), step, {"scheduled_at": "double"})


def domain_stats(events: DataFrame, key: str = "domain", now: float | None = None) -> DataFrame:
    """Per key from (ts, seq, reason, ok): when the last halt ends, errors since the last success, and whether it is halted now."""
    reason = F.col("reason")
    last_ok = F.max(F.when(F.col("ok"), F.struct("ts", "seq"))).alias("last_ok")
    ends = F.max_by(F.when(reason.isNotNull(), F.col("ts") + halt_seconds(reason)), F.when(reason.isNotNull(), F.struct("ts", "seq"))).alias("halted_until")
    base = events.groupBy(key).agg(last_ok, ends, F.max("ts").alias("last_seen"))
    joined = events.where("reason is not null").join(base.select(key, "last_ok"), key).where(F.col("last_ok").isNull() | (F.struct("ts", "seq") > F.col("last_ok")))
    errors = joined.groupBy(key).agg(F.count("*").alias("consecutive_errors"))
    at = F.lit(now) if now is not None else F.col("last_seen")
    out = base.join(errors, key, "left")
    return out.select(key, F.coalesce("halted_until", F.lit(0.0)).alias("halted_until"), F.coalesce("consecutive_errors", F.lit(0)).alias("consecutive_errors"), (F.coalesce("halted_until", F.lit(0.0)) > at).alias("is_halted"))


def limiter_report(requests: DataFrame, events: DataFrame, toggles: DataFrame, key: str = "domain", *, max_tokens: int = OPTIONS.max_tokens, refill_rate: float = OPTIONS.refill_rate, now: float | None = None) -> DataFrame:
    """Per domain: tokens left after its last request, max_tokens, and of domain_stats the errors in a row, the end of the halt and whether it holds, with strict_mode by the last toggle."""
    bucket = token_bucket(requests, key, max_tokens=max_tokens, refill_rate=refill_rate)
    left = bucket.groupBy(key).agg(F.max_by("tokens", F.struct("ts", "seq")).alias("tokens"))
    mode = toggles.groupBy(key).agg(F.max_by("strict", F.struct("ts", "seq")).alias("strict_mode"))
    out = left.join(domain_stats(events, key, now), key, "full").join(mode, key, "full")
    full = lambda name, value: F.coalesce(F.col(name), F.lit(value)).alias(name)
    return out.select(key, full("tokens", float(max_tokens)), F.lit(max_tokens).alias("max_tokens"), full("consecutive_errors", 0), full("strict_mode", False), full("halted_until", 0.0), full("is_halted", False))


def proxy_health(outcomes: DataFrame, key: str = "proxy", *, max_failures: int = 3) -> DataFrame:
    """Per key from (ts, seq, ok, response_time): health, failures in a row, totals and the moving average of response times.

    A success heals and resets; the average takes the first sample as it is and
    then four parts old to one part new, and an average of zero counts as unset.
    Times are not negative. A null ok is a failure; a success of null time is no
    sample. Of a stretch of the log it is enough to know the average that comes
    of an unset one, and the factor and the summand for any other, so stretches
    are folded apart and there are no more of them for a key than partitions.
    """
    rows = outcomes.select(F.col(key).alias("k"), "ts", "seq", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("response_time").cast("double").alias("took"))
    names = ["k", "part", "n", "good", "fails", "unset", "factor", "summand"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, kind = TaskContext.get().partitionId(), None, None
        new = (0, 0, 0, 0.0, 1.0, 0.0)
        n, good, fails, unset, factor, summand = new

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at, kind), *(pa.array([x]) for x in (part, n, good, fails, unset, factor, summand))], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, ok, took in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if at != [k]:
                    if at is not None:
                        yield row()
                    at, (n, good, fails, unset, factor, summand) = [k], new
                n, good, fails = n + 1, good + ok, 0 if ok else fails + 1
                if ok and took is not None:
                    unset = took if unset == 0 else unset * 0.8 + took * 0.2
                    factor, summand = factor * 0.8, summand * 0.8 + took * 0.2
        if at is not None:
            yield row()

    kind = rows.schema["k"].dataType.simpleString()
    dealt = rows.repartitionByRange("k", "ts", "seq").sortWithinPartitions("k", "ts", "seq", "ok", "took")
    parts = dealt.mapInArrow(stretches, f"k {kind}, part long, n long, good long, fails long, unset double, factor double, summand double")
    log = F.array_sort(F.collect_list(F.struct("part", "n", "good", "fails", "unset", "factor", "summand")))
    start = F.struct(F.lit(0).cast("long").alias("fails"), F.lit(0.0).alias("avg"))

    def join(a: Column, e: Column) -> Column:
        fails = F.when(e["good"] > 0, e["fails"]).otherwise(a["fails"] + e["fails"])
        avg = F.when(a["avg"] == 0, e["unset"]).otherwise(a["avg"] * e["factor"] + e["summand"])
        return F.struct(fails.alias("fails"), avg.alias("avg"))

    folded = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), log.alias("log")).withColumn("s", F.aggregate("log", start, join))
    healthy = (F.col("s.fails") == 0) | (F.col("s.fails") < max_failures)
    return folded.select(F.col("k").alias(key), healthy.alias("is_healthy"), F.col("s.fails").cast("int").alias("failure_count"), F.col("s.avg").alias("avg_response_time"), F.col("n").cast("int").alias("total_requests"), (100.0 * F.col("good") / F.col("n")).alias("success_rate"))


def pool_stats(health: DataFrame, strategy: str = "round_robin") -> DataFrame:
    return health.agg(F.count("*").alias("total"), F.count_if("is_healthy").alias("healthy"), F.count_if(~F.col("is_healthy")).alias("unhealthy"), F.lit(strategy).alias("strategy"))


def assign_round_robin(rows: DataFrame, choices: list[str], seq: str = "seq", into: str = "choice") -> DataFrame:
    """rows with the choice whose turn it is; null if there are none."""
    if not choices:
        return rows.withColumn(into, F.lit(None).cast("string"))
    return rows.withColumn(into, F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.col(seq), F.lit(len(choices))) + 1).cast("int")))


def assign_random(rows: DataFrame, choices: list[str], key: str = "seq", into: str = "choice", seed: int = 3) -> DataFrame:
    """rows with one of the choices, each as likely, the same for the same key and seed; null if there are none."""
    if not choices:
        return rows.withColumn(into, F.lit(None).cast("string"))
    return rows.withColumn(into, F.element_at(F.array(*map(F.lit, choices)), (F.floor(chance(F.col(key), seed) * len(choices)) + 1).cast("int")))


def desktop_only(profiles: DataFrame) -> DataFrame:
    """Browser profiles (user_agent, sec_ch_ua_mobile) that aren't mobile."""
    mobile = (F.col("sec_ch_ua_mobile") == "?1") | F.contains("user_agent", F.lit("Mobile"))
    return profiles.where(~F.coalesce(mobile, F.lit(False)))
