"""robots.txt: rules from bodies, and which URLs they let through.

Rules of the agent are matched as the standard library does: the first rule
whose path is a prefix of the quoted path decides, an empty Disallow allows
everything, no rule means allowed.
"""

from __future__ import annotations

import bisect
import urllib.parse
from collections.abc import Iterable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import domain

#: What stands for a body that could not be had.
DENY_ALL = "User-agent: *\nDisallow: /"


def body_by_status(status: Column, body: Column) -> Column:
    """The body for 200, nothing (all allowed) for 403 and 404, else deny everything; null is a network error."""
    return F.when(status == 200, F.coalesce(body, F.lit(""))).when(status.isin(403, 404), F.lit("")).otherwise(F.lit(DENY_ALL))


def rules_of(agent: str = "*"):
    """A function of bodies: the agent's rules in order, its crawl delay and the sitemaps."""

    @F.pandas_udf("rules array<struct<allow: boolean, path: string>>, crawl_delay double, sitemaps array<string>")
    def run(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for body in bodies:
            parser = RobotFileParser()
            parser.parse((body or "").splitlines())
            entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
            delay = entry.delay if entry else None
            rules = [{"allow": bool(r.allowance), "path": r.path} for r in entry.rulelines] if entry else []
            out.append({"rules": rules, "crawl_delay": None if delay is None else float(delay), "sitemaps": parser.site_maps() or []})
        return pd.DataFrame(out, columns=["rules", "crawl_delay", "sitemaps"])

    return run


def path_of(url: str | None) -> str:
    """What rules are matched with: path, parameters, query and fragment, unquoted and quoted anew."""
    parts = urllib.parse.urlparse(urllib.parse.unquote(url or ""))
    return urllib.parse.quote(urllib.parse.urlunparse(("", "", *parts[2:]))) or "/"


@F.pandas_udf(T.StringType())
def match_path(urls: pd.Series) -> pd.Series:
    return urls.map(path_of)


class RuleTrie:
    """The rules of a domain as a trie in a sorted list: each path with the longest other one that it begins with.

    A rule that begins with an earlier one never decides, so it goes. Of the
    rules left that a path begins with the longest is then the first in order.
    It is the path that sorts last before the one asked for, or one that this
    begins with: a search by halves, and steps up that are no more than the path is long.
    """

    def __init__(self, rules: Iterable[tuple[bool, str]]):
        first: dict[str, tuple[int, bool]] = {}
        for i, (allow, path) in enumerate(rules):
            first.setdefault("" if path == "*" else path, (i, allow))
        self.paths: list[str] = []
        self.allows: list[bool] = []
        self.up: list[int] = []
        number: list[int] = []
        below = -1  # the last one kept: those it begins with are up from it
        for path in sorted(first):
            while below >= 0 and not path.startswith(self.paths[below]):
                below = self.up[below]
            i, allow = first[path]
            if below < 0 or i < number[below]:
                self.paths.append(path)
                self.allows.append(allow)
                self.up.append(below)
                number.append(i)
                below = len(self.paths) - 1

    def allowed(self, path: str) -> bool:
        """What the first rule whose path this one begins with says; without one all is allowed."""
        at = bisect.bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.up[at]
        return self.allows[at] if at >= 0 else True


def snapshot(fetched: DataFrame, as_of: str, ttl_seconds: int = 3600) -> DataFrame:
    """The latest robots row of each domain that is no older than the time to live."""
    fresh = fetched.where(F.expr(f"fetched_at <= {as_of} AND fetched_at > {as_of} - make_interval(0, 0, 0, 0, 0, 0, {ttl_seconds})"))
    return fresh.groupBy("domain").agg(F.max_by(F.struct("status", "body"), "fetched_at").alias("r")).select("domain", "r.*")


def rule_table(robots: DataFrame, agent: str = "*", keep: list[str] | None = None) -> DataFrame:
    """domain, rules, crawl_delay and sitemaps from domain, status, body, and columns to keep."""
    keep = keep or []
    parsed = robots.select("domain", *keep, body_by_status(F.col("status"), F.col("body")).alias("body")).select("domain", *keep, rules_of(agent)("body").alias("r"))
    return parsed.select("domain", *keep, "r.rules", "r.crawl_delay", "r.sitemaps")


def first_match(rules: Column, path: Column) -> Column:
    """Whether the first rule whose path is a prefix allows; without one all is allowed."""
    hit = F.filter(rules, lambda x: (x["path"] == "*") | F.startswith(path, x["path"]))
    return F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: the rules of a domain, then its URLs; one domain's trie is held at a time, and made when a URL asks for it."""
    key, rules, trie, delay = None, None, None, None
    for batch in batches:
        domains, is_url, urls, delays = (batch.column(c).to_pylist() for c in ("domain", "is_url", "url", "crawl_delay"))
        allowed, waits = [], []
        for i, (at, asks, url) in enumerate(zip(domains, is_url, urls, strict=True)):
            if (at,) != key:
                key, rules, trie, delay = (at,), None, None, None
            if not asks:
                if rules is None and trie is None:
                    rules, delay = batch.column("rules")[i].values, delays[i]
                continue
            if rules is not None:
                trie, rules = RuleTrie((r["allow"], r["path"]) for r in rules.to_pylist()), None
            allowed.append(trie.allowed(path_of(url)) if trie else True)
            waits.append(delay)
        rows = batch.column("row").filter(batch.column("is_url"))
        yield pa.RecordBatch.from_arrays([rows, pa.array(allowed, pa.bool_()), pa.array(waits, pa.float64())], ["row", "allowed", "crawl_delay"])


def can_fetch(urls: DataFrame, rules: DataFrame, url_col: str = "url", salts: int = 16) -> DataFrame:
    """urls with `allowed` and `crawl_delay`; a domain without rules, and a null URL, allows all. If rules has a domain twice, one of the rows counts.

    Rules and URLs meet by domain, rules first, so that a task makes a trie of a
    domain's rules once and asks it for each URL, and no URL carries them.
    A domain's URLs go to `salts` tasks at most, with its rules at each.
    """
    url = F.col(url_col)
    r = rules.select("domain", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("is_url"), F.lit(None).cast("string").alias("url"), "rules", "crawl_delay")
    asked = urls.select(domain(url).alias("domain"), F.coalesce(F.pmod(F.xxhash64(url), F.lit(salts)), F.lit(0)).cast("int").alias("salt"), F.lit(True).alias("is_url"), url.cast("string").alias("url"), F.struct(*(F.col(f"`{c}`") for c in urls.columns)).alias("row"))
    both = r.unionByName(asked, allowMissingColumns=True).repartition("domain", "salt").sortWithinPartitions("domain", "salt", "is_url")
    judged = both.mapInArrow(_judged, T.StructType([T.StructField("row", asked.schema["row"].dataType), T.StructField("allowed", T.BooleanType()), T.StructField("crawl_delay", T.DoubleType())]))
    return judged.select(*(F.col(f"row.`{c}`") for c in urls.columns), "allowed", "crawl_delay")


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", respect: bool = True) -> DataFrame:
    """The rows that may be fetched; all of them if rules aren't respected."""
    return can_fetch(urls, rules, url_col).where("allowed").select(*urls.columns) if respect else urls
