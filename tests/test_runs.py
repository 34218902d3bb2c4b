"""Runs whose statistics come with the export, and results that go through their inputs once."""

import json
import logging
import random

import pytest
from pyspark.sql import functions as F

from rillweave import cli
from rillweave.operators import robots, routing, store
from rillweave.sources import exporters

FETCHES = "url string, status_code int, content string, response_time double, error string"


@pytest.fixture
def run(spark):
    urls = [(i, f"http://h{i % 3}/{p}") for i, p in enumerate(["a", "b", "private/x", "A", "c", "held", "gone", "a", "d/"] * 2)]
    offered = spark.createDataFrame(urls, "seq long, url string")
    page = "<title>t</title>" + "word " * 200
    fetches = spark.createDataFrame([(u, 200 if i % 4 else 500, page, 0.1, None) for i, (_, u) in enumerate(urls[:9]) if "gone" not in u] + [("http://h2/held", 200, "must not be taken", 0.1, None)], FETCHES)
    bodies = spark.createDataFrame([(f"h{i}", 200, "User-agent: *\nDisallow: /private") for i in range(3)], "domain string, status int, body string")
    log = store.save_rows(spark.createDataFrame([("http://h2/held", "<title>old</title> kept", 1.0)], "url string, content string, stored_at double"))
    return offered, fetches, robots.rule_table(bodies), log


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_one_job_exports_and_counts(spark, run, tmp_path):
    offered, fetches, rules, log = run
    for size in (None, 4):
        plain, queue = routing.batch_run(offered, fetches, rules, log=log, max_size=size)
        session = routing.session_stats(plain).first().asDict()
        queue = queue.first().asDict()
        want = sorted(plain.select("url", "success", "route").collect(), key=repr)
        before = executions(spark)
        results, metrics = routing.observed_run(offered, fetches, rules, log=log, max_size=size)
        exporters.to_jsonl(results, f"{tmp_path}/{size}")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert executions(spark) - before == 2  # what robots rules say is written, then one job gives the rest
        assert metrics.session() == pytest.approx(session)
        assert {k: queue[k] for k in metrics.queue()} == metrics.queue() and metrics.queue()["filtered_robots"] > 0
        assert sorted(spark.read.json(f"{tmp_path}/{size}").select("url", "success", "route").collect(), key=repr) == want


def test_python_stands_once_in_the_plan(run):
    offered, fetches, rules, log = run
    results, _ = routing.observed_run(offered, fetches, rules, log=log, max_size=5)
    plan = results.select("url", "data")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the parser and the cleaner, and no robots rules


def test_held_pages_are_one_row_and_take_no_fetch(run):
    offered, fetches, rules, log = run
    twice = fetches.unionByName(fetches.where("url = 'http://h2/held'"))
    got = routing.process(offered.select("url").distinct(), twice, log).where("url = 'http://h2/held'").collect()
    assert [(r.success, r.status_code, r.route, r.data.title, r.error, r.response_time) for r in got] == [(True, 0, "cache", "old", None, 0.0)]


def test_csv_without_rows_is_an_error_and_leaves_nothing(spark, tmp_path):
    df = spark.range(3).select("id")
    with pytest.raises(ValueError, match="no data"):
        exporters.to_csv(df.where("id > 5"), f"{tmp_path}/none")
    assert list(tmp_path.iterdir()) == []
    assert spark.read.csv(exporters.to_csv(df, f"{tmp_path}/some"), header=True).count() == 3


@pytest.mark.parametrize("kind", ["csv", "sqlite", "json"])
def test_command_line_logs_what_the_export_observed(spark, tmp_path, caplog, kind):
    rows = [(f"http://h/{i}", f"<title>t{i}</title>" + "w " * 300) for i in range(5)] + [("http://h/private", "x")]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /private")], "domain string, status int, body string").write.parquet(f"{tmp_path}/robots")
    with caplog.at_level(logging.INFO):
        path = cli.main(["--pages", f"{tmp_path}/pages", "--robots", f"{tmp_path}/robots", "--format", kind, "--folder", f"{tmp_path}/out", "--output", "x"])
    said = next(json.loads(r.message) for r in caplog.records if r.message.startswith("{"))
    assert said["session"]["urls_successful"] == 5 and said["session"]["success_rate"] == 100.0
    assert said["queue"] == {"total_added": 5, "filtered_robots": 1, "duplicates_skipped": 0, "seen_count": 5} and said["status"] == "completed"
    assert path == f"{tmp_path}/out/x"
    with caplog.at_level(logging.INFO):
        caplog.clear()
        cli.main(["--pages", f"{tmp_path}/pages", "--robots", f"{tmp_path}/robots", "--format", kind, "--folder", f"{tmp_path}/out", "--output", "y", "--url", "http://h/private"])
    assert next(json.loads(r.message) for r in caplog.records if r.message.startswith("{"))["session"]["urls_failed"] == 1


def plain_allowed(body, url):
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse(body.splitlines())
    parser.modified()
    return parser.can_fetch("*", url)


def test_first_rule_by_trie_is_the_first_rule_in_order():
    draw = random.Random(11)
    for _ in range(400):
        paths = ["/" + "".join(draw.choices("ab/", k=draw.randint(0, 6))) for _ in range(draw.randint(0, 12))] + draw.choice([[], ["*"], [""]])
        rules = [(draw.random() < 0.5, p) for p in draw.sample(paths, len(paths))]
        trie = robots.RuleTrie(rules)
        for _ in range(20):
            path = "/" + "".join(draw.choices("abc/", k=draw.randint(0, 8)))
            assert trie.allowed(path) == next((allow for allow, p in rules if p == "*" or path.startswith(p)), True)


def test_work_of_a_trie_goes_by_the_path_and_not_by_the_rules():
    class Path(str):
        asked = 0

        def startswith(self, other):
            Path.asked += 1
            return super().startswith(other)

    draw = random.Random(12)
    rules = [(i % 2 > 0, "/" + "/".join(draw.choices(["a", "b", "cc", "d"], k=draw.randint(1, 8))) + f"/{i}") for i in range(10_000)]
    trie = robots.RuleTrie(rules)
    for _ in range(300):
        path = Path(draw.choice(rules)[1] + draw.choice(["", "/more", "x"])) if draw.random() < 0.7 else Path("/a/" * draw.randint(1, 9))
        Path.asked = 0
        got = trie.allowed(path)
        assert Path.asked <= len(path) + 1
        assert got == next((allow for allow, p in rules if str(path).startswith(p)), True)


def test_ten_thousand_rules_over_hot_and_odd_domains(spark):
    draw = random.Random(13)
    body = "User-agent: *\nCrawl-delay: 4\n" + "\n".join(f"{draw.choice(['Allow', 'Disallow'])}: /{draw.choice('abc')}/{draw.randint(0, 4000)}" for i in range(10_000))
    bodies = {"big": body, "small": "User-agent: *\nDisallow: /x\nAllow: /", "é.example": "User-agent: *\nDisallow: /*\nDisallow: /é"}
    table = robots.rule_table(spark.createDataFrame([(d, 200, b) for d, b in bodies.items()] + [("down", 500, None), ("unused", 200, "")], "domain string, status int, body string"))
    urls = [f"http://big/{draw.choice('abc')}/{draw.randint(0, 5000)}" for _ in range(600)] + ["http://small/x?y", "http://small/", "http://é.example/é", "http://é.example/*", "http://down/", "http://none/", "nothing", "", None]
    df = spark.createDataFrame([(i, u, {"k": "v"}, "d", True) for i, u in enumerate(urls)], "n long, url string, rules map<string, string>, domain string, is_url boolean").repartition(5)
    got = {r.n: r for r in robots.can_fetch(df, table).collect()}
    assert len(got) == len(urls) and robots.can_fetch(df, table).columns == [*df.columns, "allowed", "crawl_delay"]
    for i, u in enumerate(urls):
        host = (u or "").split("/")[2] if u and u.startswith("http") else None
        want = host != "down" and (host not in bodies or plain_allowed(bodies[host], u))
        assert got[i].allowed == want, u
        assert got[i].crawl_delay == (4.0 if host == "big" else None) and got[i].rules == {"k": "v"} and got[i].domain == "d"
    assert robots.can_fetch(df.where("false"), table).collect() == [] and all(r.allowed for r in robots.can_fetch(df, table.where("false")).collect())


def test_several_fetches_of_a_url_give_one_row(spark):
    fetches = spark.createDataFrame([("http://h/a", 500, "bad", 0.1, None), ("http://h/a", 200, "<title>good</title>", 0.4, None), ("http://h/a", 200, "<title>timed</title>", 0.1, "late"), ("http://h/b", 429, None, 0.2, None), ("http://h/b", 429, None, 0.2, None)], FETCHES)
    asked = spark.createDataFrame([("http://h/a",), ("http://h/b",)], "url string")
    for rows in (fetches, fetches.repartition(3)):
        got = sorted((r.url, r.status_code, r.data.title if r.data else None) for r in routing.process(asked, rows).collect())
        assert got == [("http://h/a", 200, "good"), ("http://h/b", 429, None)]


def test_single_runs_of_pages_at_one_url_take_their_own_fetch(spark):
    asked = spark.createDataFrame([(1, "http://h/a"), (2, "http://h/a"), (3, "http://h/a"), (4, "http://h/private")], "page_id long, url string")
    fetches = spark.createDataFrame([(1, "http://h/a", 200, "<title>one</title>", 0.1, None), (2, "http://h/a", 500, "", 0.1, None), (4, "http://h/private", 200, "x", 0.1, None)], "page_id long, " + FETCHES)
    rules = robots.rule_table(spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /private")], "domain string, status int, body string"))
    got = routing.single_runs(asked, fetches, rules, by=["page_id"]).select("url", "success", "error", "data.title").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("http://h/a", True, None, "one"), ("http://h/a", False, "HTTP 500", None), ("http://h/a", False, "not fetched", None), ("http://h/private", False, "Blocked by robots.txt", None)], key=repr)


def visits(spark):
    """Three visits of one URL: held, deleted and fetched, and only fetched."""
    asked = spark.createDataFrame([(i, "http://h/a") for i in (1, 2, 3)], "page_id long, url string")
    fetches = spark.createDataFrame([(i, "http://h/a", 200 if i < 3 else 500, f"<title>f{i}</title>" + "word " * 300, 0.1, None) for i in (1, 2, 3)], "page_id long, " + FETCHES)
    saved = spark.createDataFrame([(i, "http://h/a", f"<title>s{i}</title>", 1.0) for i in (1, 2)], "page_id long, url string, content string, stored_at double")
    gone = spark.createDataFrame([(2, "http://h/a", 3.0)], "page_id long, url string, stored_at double")
    return asked, fetches, store.save_rows(saved, by=["page_id"]).unionByName(store.delete_rows(gone, by=["page_id"]))


def test_visits_of_one_url_have_their_own_history(spark):
    asked, fetches, log = visits(spark)
    got = sorted((r.route, r.status_code, r.data.title if r.data else None) for r in routing.process(asked, fetches, log, by=["page_id"]).collect())
    assert got == [("cache", 0, "s1"), ("failed", 500, None), ("http", 200, "f2")]
    assert {r.route for r in routing.process(asked, fetches, log).collect()} == {"http"}  # told by the URL alone, the delete is the last word


def test_session_stats_count_each_visit_once(spark):
    asked, fetches, log = visits(spark)
    got = routing.session_stats(routing.process(asked, fetches, log, by=["page_id"])).first()
    assert (got.urls_processed, got.urls_successful, got.urls_failed, got.http_fetches, got.chars_downloaded) == (3, 2, 1, 1, len("<title>f2</title>" + "word " * 300))


def test_a_batch_takes_the_visit_that_was_first(spark):
    asked, fetches, log = visits(spark)
    offered = asked.select((4 - F.col("page_id")).alias("seq"), "page_id", "url")
    results, queue = routing.batch_run(offered.where("page_id < 3"), fetches, log=log, by=["page_id"])
    assert [(r.route, r.data.title) for r in results.collect()] == [("http", "f2")]
    assert routing.batch_run(offered, fetches, log=log, by=["page_id"])[0].first().error == "HTTP 500"
    assert queue.first().duplicates_skipped == 1


def test_batch_stats_count_a_url_that_was_fetched_twice_once(spark):
    asked, fetches, log = visits(spark)
    results, queue = routing.batch_run(asked.withColumn("seq", F.col("page_id")), fetches, log=log, by=["page_id"])
    got = routing.combined_stats(results, queue).select("session.urls_processed", "session.urls_successful", "queue.total_added", "queue.duplicates_skipped").first()
    assert tuple(got) == (1, 1, 1, 2)
    results, queue = routing.batch_run(asked.withColumn("seq", F.col("page_id")), fetches)
    assert routing.combined_stats(results, queue).first().session.urls_processed == 1


def test_an_observed_run_counts_visits_as_it_exports_them(spark, tmp_path):
    asked, fetches, log = visits(spark)
    for order, browser, title in ((F.col("page_id"), 0, "s1"), (4 - F.col("page_id"), 0, None)):
        results, metrics = routing.observed_run(asked.withColumn("seq", order), fetches, log=log, by=["page_id"])
        path = exporters.to_jsonl(results.select("url", "route", "data.title"), f"{tmp_path}/{title}")
        assert [r.asDict().get("title") for r in spark.read.schema("url string, route string, title string").json(path).collect()] == [title]
        assert (metrics.session()["urls_processed"], metrics.session()["browser_fetches"], metrics.queue()["duplicates_skipped"]) == (1, browser, 2)


def test_urls_the_log_and_fetches_move_once_each(spark, tmp_path):
    for name, df in zip(("asked", "fetches", "log"), visits(spark)):
        df.write.parquet(f"{tmp_path}/{name}")
    asked, fetches, log = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("asked", "fetches", "log"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for by in ([], ["page_id"]):
            plan = routing.process(asked, fetches, log, by=by)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
