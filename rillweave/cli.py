"""Command line: a page corpus and a list of URLs to an export."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import limiter, robots, routing
from .options import OPTIONS
from .sources import exporters, lists


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description="Parse pages that are on disk and export their records")
    p.add_argument("--pages", required=True, help="Parquet with url and html")
    p.add_argument("--url", "-u", help="one URL; without URLs all pages are taken")
    p.add_argument("--file", "-f", help="URLs, one a line")
    p.add_argument("--workers", "-w", type=int, default=OPTIONS.workers, help="partitions to parse in")
    p.add_argument("--robots", help="Parquet with domain, status and body of robots.txt files")
    p.add_argument("--proxies", "-p", help="proxies, one a line: dealt out to the URLs in turn and logged")
    p.add_argument("--capacity", type=int, default=OPTIONS.queue_size, help="how many URLs the frontier takes")
    p.add_argument("--format", choices=sorted(exporters.EXPORTERS), default="json")
    p.add_argument("--output", "-o", help="file name, of the time if not given")
    p.add_argument("--folder", default=OPTIONS.export_folder)
    p.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"], default="INFO")
    o = p.parse_args(args)
    logging.basicConfig(level=o.log_level)
    spark = SparkSession.builder.getOrCreate()
    fetched = lists.page_corpus(spark, o.pages)
    wanted = lists.urls(spark, o.file, [o.url] if o.url else None) if o.url or o.file else fetched.select("url", F.monotonically_increasing_id().alias("seq"))
    if o.proxies:
        names = [r.proxy for r in lists.proxies(spark, o.proxies).orderBy("seq").collect()]  # a list of proxies is short
        wanted = limiter.assign_round_robin(wanted, names, into="proxy")
        fetched = fetched.drop("used_proxy").join(wanted.groupBy("url").agg(F.min("proxy").alias("used_proxy")), "url", "left")
    rules = robots.rule_table(spark.read.parquet(o.robots)) if o.robots else None
    if o.url and not o.file and rules is not None:
        results, seen = routing.single_runs(wanted.select("url"), fetched, rules), Observation()
        path = exporters.export(routing.export_rows(results.observe(seen, *routing.session_counts())), o.format, o.folder, o.output)
        stats = {"session": routing.with_rates(seen.get)}
    else:
        results, metrics = routing.observed_run(wanted.repartition(o.workers), fetched, rules, max_size=o.capacity)
        path = exporters.export(routing.export_rows(results), o.format, o.folder, o.output)
        stats = {"session": metrics.session(), "queue": metrics.queue(), "status": "completed"}
    logging.info("%s", json.dumps(stats))
    logging.info("exported to %s", path)
    return path


if __name__ == "__main__":
    main()
