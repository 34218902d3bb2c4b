"""Pages by host; site classification; URL keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, urls
from .tables import pages, spa_pages

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_VISIBLE = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?i)<script[^>]*>[\s\S]*?</script>', '', 'g'), '(?i)<style[^>]*>[\s\S]*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_SPACE}', ' ', 'g'))"""
_DOMAIN = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"


def host_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: pages, visible characters, bytes, pages that need a browser."""
    p = pages(spark, sf_dir).select(urls.domain(F.col("url")).alias("host"), F.char_length(detect.visible_text(F.col("html"))).alias("visible"), F.octet_length("html").alias("bytes"), detect.needs_browser_quick(F.col("html")).alias("browser"))
    return p.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("visible").alias("visible_chars"), F.sum("bytes").alias("n_bytes"), F.count_if("browser").alias("n_browser"))


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.dedup_key(u).alias("dedup_key"), urls.storage_key(u).alias("storage_key"), urls.storage_filename(u, F.when(F.col("page_id") % 3 == 0, F.lit("json")).otherwise(F.lit("html"))).alias("filename"), urls.domain(u).alias("domain"), urls.robots_url(u).alias("robots_url"), urls.robots_cache_key(urls.domain(u)).alias("cache_key"))


def site_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spa_pages(spark, sf_dir).select("page_id", detect.analyze(F.col("html")).alias("s"))
    return s.select("page_id", "s.site_type", F.round("s.confidence", 6).alias("confidence"), "s.requires_browser", F.array_join("s.frameworks", "|").alias("frameworks"), F.array_join("s.reasons", "|").alias("reasons"))


def site_quick_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spa_pages(spark, sf_dir).select("page_id", detect.needs_browser_quick(F.col("html")).alias("needs_browser"))


def site_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return spa_pages(spark, sf_dir).select("page_id", F.array_join(detect.dynamic_markers(h), " ~ ").alias("markers"), detect.looks_static(h).alias("static"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SPA = """spa AS (SELECT page_id, CASE page_id % 7
    WHEN 0 THEN '<html><body><div id="root"></div><script src="/static/react-dom.js"></script></body></html>'
    WHEN 1 THEN html || '<script id="__NEXT_DATA__">{}</script>'
    WHEN 2 THEN '<div id="app"> </div><script>window.__INITIAL_STATE__={}; hydrate (x)</script><i data-v-1f>' || html
    WHEN 3 THEN html || '<link href="/_nuxt/entry.js"><p class="svelte-a1b2">'
    ELSE html END AS html FROM pages)"""
_NAMES = ", ".join(f"CASE WHEN regexp_matches(html, {_sql_text('(?i)' + '|'.join(p))}) THEN '{n}' END" for n, p in detect.FRAMEWORKS.items())
_MARKERS = ", ".join(f"CASE WHEN regexp_matches(html, {_sql_text('(?i)' + p)}) THEN {_sql_text(p[:50])} END" for p in detect.DYNAMIC_MARKERS)
# RE2 bounds repetition at 1,000, which 500 is under.
_STATIC = " OR ".join(f"regexp_matches(html, {_sql_text('(?i)' + p)})" for p in detect.STATIC_MARKERS)
_LITERALS = " OR ".join(f"contains(html, {_sql_text(t)})" for t in detect.QUICK_LITERALS)

QUERIES = {"host_profile": host_profile, "url_keys": url_keys, "site_analysis": site_analysis, "site_quick_check": site_quick_check, "site_markers": site_markers}
ORACLE_SQL = {
    "host_profile": f"""
        SELECT {_DOMAIN} AS host, count(*) AS n_pages, sum(length({_VISIBLE}))::BIGINT AS visible_chars, sum(strlen(html))::BIGINT AS n_bytes,
               count(*) FILTER (length(html) < 1000 OR {_LITERALS} OR length({_VISIBLE}) < 200) AS n_browser
        FROM pages GROUP BY 1""",
    "url_keys": f"""
        SELECT page_id, md5(lower(rtrim(url, '/'))) AS dedup_key, substr(sha256(url), 1, 16) AS storage_key,
               substr(sha256(url), 1, 16) || CASE WHEN page_id % 3 = 0 THEN '.json' ELSE '.html' END AS filename, {_DOMAIN} AS domain,
               regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_DOMAIN} || '/robots.txt' AS robots_url, 'robots_' || md5({_DOMAIN}) AS cache_key
        FROM pages""",
    "site_analysis": f"""
        WITH {_SPA}, f AS (SELECT page_id, list_filter([{_NAMES}], lambda x: x IS NOT NULL) AS names, list_filter([{_MARKERS}], lambda x: x IS NOT NULL) AS marks,
             length({_VISIBLE}) AS chars, {_STATIC} AS static FROM spa),
        c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN len(names) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(marks) > 0 THEN 0.15::DOUBLE ELSE 0 END
             + CASE WHEN chars < 500 THEN 0.15::DOUBLE ELSE -0.2::DOUBLE END - CASE WHEN static THEN 0.3::DOUBLE ELSE 0 END)) AS score FROM f)
        SELECT page_id, CASE WHEN score > 0.6 THEN 'dynamic' WHEN score < 0.4 THEN 'static' ELSE 'unknown' END AS site_type, round(score, 6) AS confidence,
               CASE WHEN score > 0.6 THEN true WHEN score < 0.4 THEN false ELSE len(names) > 0 END AS requires_browser, array_to_string(names, '|') AS frameworks,
               concat_ws('|', CASE WHEN len(names) > 0 THEN 'Detected frameworks: ' || array_to_string(names, ', ') END, CASE WHEN len(marks) > 0 THEN 'Found ' || len(marks) || ' dynamic pattern(s)' END,
                         CASE WHEN chars < 500 THEN 'Low' ELSE 'Sufficient' END || ' text content (' || chars || ' chars)', CASE WHEN static THEN 'Content appears fully rendered' END) AS reasons
        FROM c""",
    "site_quick_check": f"WITH {_SPA} SELECT page_id, length(html) < 1000 OR {_LITERALS} OR length({_VISIBLE}) < 200 AS needs_browser FROM spa",
    "site_markers": f"WITH {_SPA} SELECT page_id, array_to_string(list_filter([{_MARKERS}], lambda x: x IS NOT NULL), ' ~ ') AS markers, {_STATIC} AS static FROM spa",
}
