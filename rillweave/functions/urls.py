"""Keys and parts of URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedup_key(url: Column) -> Column:
    """MD5 of the lower-cased URL without its trailing slashes."""
    return F.md5(F.lower(F.rtrim(url, F.lit("/"))))


def storage_key(url: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the URL as it is."""
    return F.substring(F.sha2(url, 256), 1, 16)


def storage_filename(url: Column, content_type: Column) -> Column:
    return F.concat(storage_key(url), F.when(content_type == "json", F.lit(".json")).otherwise(F.lit(".html")))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def domain(url: Column) -> Column:
    """The network location with port and user part, case kept; empty if the URL has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), domain(url), F.lit("/robots.txt"))


def robots_cache_key(of_domain: Column) -> Column:
    return F.concat(F.lit("robots_"), F.md5(of_domain))
