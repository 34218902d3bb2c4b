"""Cases by hand: cleaning, prices, robots against the standard library, folds, extraction, sinks, streams."""

import csv
import json
import os
import random
import sqlite3
import sys
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from rillweave import cli
from rillweave.functions import html, text, urls
from rillweave.operators import frontier, limiter, robots, routing, store, validate
from rillweave.sources import exporters, lists
from rillweave.streaming import pages as streams


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_cleaning(spark):
    cases = [("  Hello    World!  ", "Hello World!"), ("Price: &amp; 10 &lt; 20", "Price: & 10 < 20"), (None, ""), ("", ""), ("a  b\x00c", "a bc"), ("ﬁ Ａ", "fi A"), ("Hi \U0001f44b\U0001f30d", "Hi"), ("日本 ok", "ok"), ("&amp;lt;", "&lt;")]
    for raw, want in cases:
        assert one(spark, raw, text.DEFAULT.clean) == want
    assert one(spark, "Hi \U0001f44b", text.MINIMAL.clean) == "Hi \U0001f44b"
    assert one(spark, "cost: $5 (ok)", text.STRICT.clean) == "cost 5 ok"
    assert one(spark, "日本 \U0001f44b", text.Cleaner(narrow_emojis=True).clean) == "日本"


def test_prices(spark):
    cases = {"$19.99": 19.99, "€ 15,50": 15.5, "£100": 100.0, "": None, "¥ 1,234": 1.234, "1,234.56": 1.23456, "1.2.3": None, ".": None, "-5": 5.0, "none": None}
    for raw, want in cases.items():
        assert one(spark, raw, text.clean_price) == want


def test_urls(spark):
    for u, want in {"https://example.com/page": "example.com", "https://api.example.com/v1": "api.example.com", "http://localhost:8000/test": "localhost:8000", "//h/x": "h", "no scheme": "", "http://a b/x": "a b"}.items():
        assert one(spark, u, urls.domain) == want
    assert one(spark, "https://example.com/page/sub", urls.robots_url) == "https://example.com/robots.txt"


def test_robots_like_the_standard_library(spark):
    draw = random.Random(4)
    bodies = []
    for _ in range(25):
        lines = ["User-agent: *"] + [f"{draw.choice(['Allow', 'Disallow'])}: {draw.choice(['/', '', '/a', '/a/b', '/ü', '/c?d=1', '*'])}" for _ in range(draw.randint(0, 5))]
        bodies.append("\n".join(lines))
    paths = ["", "/", "/a", "/a/b/c", "/ü/x", "/%C3%BC", "/c?d=1&e", "/z#f"]
    table = spark.createDataFrame([(f"h{i}", 200, b) for i, b in enumerate(bodies)] + [("gone", 404, None), ("bad", 500, None)], "domain string, status int, body string")
    asked = [(f"http://h{i}{p}",) for i in range(25) for p in paths] + [("http://gone/a",), ("http://bad/a",), ("http://unknown/a",)]
    got = {r.url: r.allowed for r in robots.can_fetch(spark.createDataFrame(asked, "url string"), robots.rule_table(table)).collect()}
    for i, b in enumerate(bodies):
        parser = RobotFileParser()
        parser.parse(b.splitlines())
        parser.modified()
        for p in paths:
            assert got[f"http://h{i}{p}"] == parser.can_fetch("*", f"http://h{i}{p}"), (b, p)
    assert got["http://gone/a"] and not got["http://bad/a"] and got["http://unknown/a"]
    assert robots.filter_urls(spark.createDataFrame([], "url string"), robots.rule_table(table)).collect() == []


def test_references_without_a_semicolon(spark):
    page = "<title>a&amp;b&amp</title><p>&copy=1 & &#65; &#x42; &#67 &nosuch; &lt;i&gt;</p>"
    assert one(spark, page, text.page_text) == "a&b& ©=1 & A B C &nosuch; <i>"
    assert one(spark, page, lambda c: text.page_text(text.ended_references(c))) == "a&b&amp &copy=1 & A B &#67 &nosuch; <i>"
    assert one(spark, None, text.ended_references) is None


def test_titles_cut_inside_a_reference(spark):
    page = "<html><head><title>a&amp;&amp</title></head><body><h1>b &lt;&copy</h1><a href='http://x/?a=1&amp;b&copy=2'>to</a>"
    for made, want in ((F.col("page"), ("a&&", "b <©", 1)), (text.ended_references(F.col("page")), ("a&&amp", "b <&copy", 1))):
        got = spark.createDataFrame([(page,)], "page string").select(html.extract(made, fields=["title", "h1", "links_count"]).alias("r")).select("r.title", "r.h1", "r.links_count").first()
        assert tuple(got) == want


def test_frontier_like_one_by_one(spark):
    draw = random.Random(6)
    for size in (1, 3, 50):
        offers = [(i, f"http://x/{draw.randrange(8)}", draw.random() < 0.6, 2) for i in range(60)]
        seen, queue, want = set(), 0, {}
        for i, u, ok, _ in offers:
            if u in seen:
                want[i] = "duplicate"
            elif queue >= size:
                want[i] = "rejected_full"
            elif not ok:
                want[i] = "filtered"
            else:
                seen.add(u)
                queue += 1
                want[i] = "added"
        got = frontier.disposition(spark.createDataFrame(offers, "seq long, url string, allowed boolean, priority int"), size)
        assert {r.seq: r.disposition for r in got.collect()} == want
    assert frontier.peek(got).first().seq == 0


def test_keys_seen_more_than_once_do_not_multiply_urls(spark):
    offers = spark.createDataFrame([(i, f"http://x/{i % 3}", True) for i in range(6)], "seq long, url string, allowed boolean")
    seen = frontier.seen_keys(frontier.disposition(offers.where("seq < 1")))
    want = {0: "duplicate", 1: "added", 2: "rejected_full", 3: "duplicate", 4: "duplicate", 5: "rejected_full"}
    for keys in (seen, seen.unionByName(seen).unionByName(seen)):
        got = frontier.disposition(offers, 1, keys).collect()
        assert len(got) == 6 and {r.seq: r.disposition for r in got} == want


def test_limiter(spark):
    asked = spark.createDataFrame([("d", 0.0, i, 0.0, None) for i in range(7)], "domain string, ts double, seq long, delay double, halt double")
    assert [r.admitted for r in limiter.token_bucket(asked, refill_rate=1.0).orderBy("seq").collect()] == [True] * 5 + [False] * 2
    assert [round(r.scheduled_at, 6) for r in limiter.schedule(asked, refill_rate=1.0).orderBy("seq").collect()] == [0, 0, 0, 0, 0, 1, 2]
    assert one(spark, 0.0, lambda c: limiter.wait_for(c, 2, 1.0), "double") == 2.0
    halted = spark.createDataFrame([("d", 0.0, 0, 3.0, 60.0), ("d", 1.0, 1, 3.0, None), ("d", 2.0, 2, 3.0, None)], "domain string, ts double, seq long, delay double, halt double")
    assert [r.scheduled_at for r in limiter.schedule(halted).orderBy("seq").collect()] == [0.0, 60.0, 63.0]
    assert 2 <= one(spark, "u", limiter.jitter) <= 5
    odd = spark.createDataFrame([(None, None, 0, None, None), (None, None, 1, None, None), ("e", None, 0, None, None)], asked.schema)
    assert sorted(r.tokens for r in limiter.token_bucket(odd).collect()) == [3.0, 4.0, 4.0]
    assert [r.scheduled_at for r in limiter.schedule(odd).collect()] == [0.0] * 3
    assert limiter.token_bucket(asked.limit(0)).collect() == limiter.schedule(asked.limit(0)).collect() == []


def test_health_of_a_hot_proxy_dealt_out(spark):
    rows = [("hot" if i % 5 else None, float(i // 3), i, None if i % 50 == 7 else i % 4 != 1 and i < 497, (i % 13) / 4 if i % 6 else None) for i in range(500)]
    want = {}
    for k, _, _, ok, took in rows:
        n, good, fails, avg = want.get(k, (0, 0, 0, 0.0))
        if ok and took is not None:
            avg = took if avg == 0 else avg * 0.8 + took * 0.2
        want[k] = (n + 1, good + bool(ok), 0 if ok else fails + 1, avg)
    frame = spark.createDataFrame(rows, "proxy string, ts double, seq long, ok boolean, response_time double").repartition(3)
    got = {r.proxy: r for r in limiter.proxy_health(frame).collect()}
    assert got.keys() == want.keys()
    for k, (n, good, fails, avg) in want.items():
        assert (got[k].total_requests, got[k].failure_count, got[k].is_healthy) == (n, fails, fails < 3)
        assert abs(got[k].success_rate - 100 * good / n) < 1e-9 and abs(got[k].avg_response_time - avg) < 1e-9
    assert limiter.proxy_health(frame.limit(0)).collect() == []


def test_validation(spark):
    df = spark.createDataFrame([("a", 10.0), (None, -5.0), ("  ", None)], "title string, price double")
    rows = validate.validate(df, ["title"], {"price": validate.positive_number})
    assert [(r.is_valid, [i.severity for i in r.issues]) for r in rows.collect()] == [(True, []), (False, ["error", "warning"]), (False, ["error"])]
    assert validate.summary(rows).first().asDict() == {"total": 3, "valid": 1, "invalid": 2, "success_rate": pytest.approx(100 / 3)}
    for v, want in {"10": None, "0": "Value must be positive", "abc": "Value must be a number", "1d": "Value must be a number", "nan": None}.items():
        assert one(spark, v, validate.positive_number) == want
    assert one(spark, 123, validate.non_empty_string, "int") == "Value must be a string"


def test_extraction_of_odd_pages():
    page = "<title> a <b>x</b></title><h1>h</h1><body><a href='http://q'>l<script>no</script></a><main>one<nav><div class=quote><span class=text>gone</span></div></nav><p>two<p>three</main>"
    r = html.page_record(page)
    assert (r["h1"], r["links"], r["text_length"], r["text_preview"], r["quotes"]) == ("h", [{"url": "http://q", "text": "l"}], 13, "one two three", None)
    for bad in ("", "<", "<<<>>>", "</p></div>", "<a href>", "<li><li><table><td><td>", "<div" * 50, "<p>" * 3000):
        assert html.page_record(bad)["links_count"] == 0
    card = "<div class='products-grid'><div class='product'><a>n1</a></div><div class='product'><a>n2</a></div></div>"
    assert [p["name"] for p in html.page_record(card)["products"]] == ["n1", "n1", "n2"]


def test_a_parser_of_ones_own_may_fail(spark):
    def parser(page):
        if "bad" in page:
            raise ValueError("no")
        return {"n": len(page), "parse_error": None}

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "html string").select(html.extract(F.col("html"), parser, "n int, parse_error string").alias("r"))
    assert [(r.r.n, r.r.parse_error) for r in df.collect()] == [(2, None), (None, "ValueError: no"), (0, None)]


def test_store(spark, tmp_path):
    held = store.RawStore(spark, f"file://{tmp_path}/s")
    assert held.list_all().count() == 0
    held.save(spark.createDataFrame([("u", "é", 1.0), ("v", "b", 1.0)], "url string, content string, stored_at double"))
    held.save(spark.createDataFrame([("u", "new", 2.0)], "url string, content string, stored_at double"))
    held.delete(spark.createDataFrame([("v", 3.0)], "url string, stored_at double"))
    assert store.load(held.log(), "u").first().content == "new" and store.load(held.log(), "v").count() == 0
    assert store.stats(held.log()).first().total_size_bytes == 3
    assert held.clear() == 1 and held.list_all().count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é,\"q\"", {"a": 2}, [1, 2], True), (2, None, {"a": None}, None, False)], "id2 int, s string, m struct<a: int>, l array<int>, b boolean")
    folder = str(tmp_path)
    rows = json.load(open(exporters.export(df, "json", folder, "x.json"), encoding="utf-8"))
    assert sorted(r["id2"] for r in rows) == [1, 2] and rows[0].keys() == {"id2", "s", "m", "l", "b"}
    assert json.load(open(exporters.to_json(df.limit(0), f"{folder}/e.json"))) == []
    made = exporters.export(df.coalesce(1), "csv", folder, "x.csv")
    got = list(csv.DictReader(open(exporters.single_file(made, f"{folder}/one.csv", header=True), encoding="utf-8")))
    assert list(got[0]) == ["b", "id2", "l", "m_a", "s"] and got[0]["s"] == "é,\"q\"" and got[1]["m_a"] == ""
    for replace, n in ((False, 2), (False, 4), (True, 2)):
        exporters.export(df, "sqlite", folder, "x.db", replace=replace)
        assert sqlite3.connect(f"{folder}/x.db").execute("SELECT count(*), count(_scraped_at), sum(b) FROM scraped_data").fetchone() == (n, n, n // 2)
    for kind in ("csv", "sqlite"):
        with pytest.raises(ValueError):
            exporters.export(df.limit(0), kind, folder, "none")
    with pytest.raises(ValueError):
        exporters.export(df, "xml", folder)
    assert exporters.auto_filename("csv").startswith("export_")


def test_lists_and_command_line(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# no\n\n  http://a/1  \nhttp://b/2\n")
    got = lists.urls(spark, f"file://{tmp_path}/u.txt", ["http://z"]).orderBy("seq").collect()
    assert [r.url for r in got] == ["http://z", "http://a/1", "http://b/2"]
    spark.createDataFrame([("http://a/1", "<title>t</title>" + "<p>word " * 300)], "url string, html string").write.parquet(f"{tmp_path}/p")
    path = cli.main(["--pages", f"{tmp_path}/p", "--file", f"{tmp_path}/u.txt", "--folder", str(tmp_path / "out"), "--output", "r.json"])
    rows = {r["url"]: r for r in json.load(open(path))}
    assert rows["http://a/1"]["title"] == "t" and rows["http://b/2"]["error"] == "not fetched"


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"http://h{i % 3}/{i % 20}", f"<title>t{i % 20}</title><p>a &amp; b", f"h{i % 3}", float(i // 4), i) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, html string, domain string, ts double, seq long")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.parsed_pages(stream).writeStream.format("memory").queryName("parsed").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT url, data.title FROM parsed").collect()
    assert len(got) == len({r[0] for r in rows}) and all(r.title for r in got)
    q = streams.admitted(stream, refill_rate=0.1).writeStream.format("memory").queryName("bucket").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.domain, r.seq, r.admitted) for r in limiter.token_bucket(df, refill_rate=0.1).collect()}
    assert {tuple(r) for r in spark.table("bucket").collect()} == want and not all(w[2] for w in want)


def test_host_windows_of_a_stream(spark, tmp_path):
    rows = [(f"http://h{i % 2}/{i}", "é" * i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "url string, html string, s long").select("url", "html", F.timestamp_seconds(F.lit(1_700_000_100) + F.col("s") * 30).alias("ts"))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = streams.host_windows(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("hosts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.host): (r.n_pages, r.n_bytes) for r in spark.table("hosts").select("window.start", "host", "n_pages", "n_bytes").collect()}
    want = df.groupBy(F.window("ts", "5 minutes"), urls.domain(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).select("window.start", "host", "n", "b").collect()
    assert got == {(r.start, r.host): (r.n, r.b) for r in want} and len(got) > 4


def test_exporters_of_ones_own(spark, tmp_path):
    exporters.register("names", "txt", lambda df, path: df.select("a").write.text(path) or path)
    try:
        path = exporters.export(spark.createDataFrame([("x",), ("y",)], "a string"), "names", str(tmp_path), "n.txt")
        assert sorted(r.value for r in spark.read.text(path).collect()) == ["x", "y"]
        with pytest.raises(ValueError):
            exporters.register("json", "json", exporters.to_json)
    finally:
        del exporters.EXPORTERS["names"]


def test_plans(spark):
    p = spark.createDataFrame([("http://a/1", "<p>x")], "url string, html string")
    plan = routing.process(p.select("url"), lists_like(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 0
    assert os.path.exists(os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))


def lists_like(p):
    return p.select("url", F.lit(200).alias("status_code"), F.col("html").alias("content"), F.lit(0.0).alias("response_time"), F.lit(None).cast("string").alias("error"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_options_hold_together():
    from rillweave.options import Options

    assert Options(max_tokens=1, strict_max_delay=40).strict_max_delay == 40
    for wrong in ({"max_tokens": 0}, {"refill_rate": 0}, {"min_delay": 6}, {"strict_min_delay": 31}, {"workers": 0}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_strict_mode_and_reports_of_odd_logs(spark):
    """Null keys, requests before any toggle, toggles of equal time, domains that are in one log only."""
    asked = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 3.0, 3), (None, 1.0, 4), ("c", 1.0, 5)], "domain string, ts double, seq long")
    turned = spark.createDataFrame([("a", 2.0, 2, True), ("a", 2.5, 9, None), ("b", 1.0, 1, True)], "domain string, ts double, seq long, strict boolean")
    got = {r.seq: r.strict for r in limiter.with_strict_mode(asked, turned).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}
    delays = limiter.with_strict_mode(asked, turned).select("strict", limiter.polite_delay(F.col("seq"), F.col("strict")).alias("d")).collect()
    assert all(10 <= r.d <= 30 if r.strict else 2 <= r.d <= 5 for r in delays)
    events = asked.select("*", F.lit("403").alias("reason"), F.lit(False).alias("ok"))
    report = {r.domain: r for r in limiter.limiter_report(asked, events, turned).collect()}
    assert report["b"].strict_mode and report["b"].tokens == 5.0 and not report["b"].is_halted and report["b"].consecutive_errors == 0
    assert report["a"].consecutive_errors == 3 and report["a"].halted_until == 63.0 and report["a"].is_halted and not report["a"].strict_mode
    assert limiter.assign_random(asked, []).where("choice is not null").isEmpty()


def test_cli_takes_robots_proxies_and_repeats(spark, tmp_path):
    page = "<html><head><title>t</title></head><body><h1>h</h1>" + "word " * 300 + "</body></html>"
    spark.createDataFrame([(f"http://x.example/{p}", page) for p in ("a", "b", "no")], "url string, html string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("x.example", 200, "User-agent: *\nDisallow: /no")], "domain string, status int, body string").write.parquet(f"{tmp_path}/r")
    (tmp_path / "u.txt").write_text("http://x.example/a\nhttp://x.example/A/\nhttp://x.example/b\nhttp://x.example/no\n# http://x.example/c\n")
    (tmp_path / "proxies.txt").write_text("http://p1:1\n\n#off\nhttp://p2:2\n")
    common = ["--pages", f"{tmp_path}/p", "--robots", f"{tmp_path}/r", "--folder", str(tmp_path / "out")]
    path = cli.main([*common, "--file", f"{tmp_path}/u.txt", "--proxies", f"{tmp_path}/proxies.txt", "--output", "r.json"])
    assert sorted(r["url"] for r in json.load(open(path))) == ["http://x.example/a", "http://x.example/b"]
    path = cli.main([*common, "--file", f"{tmp_path}/u.txt", "--capacity", "1", "--output", "one.json"])
    assert [r["url"] for r in json.load(open(path))] == ["http://x.example/a"]
    path = cli.main([*common, "--url", "http://x.example/no", "--output", "no.json"])
    assert [(r["success"], r["error"]) for r in json.load(open(path))] == [(False, "Blocked by robots.txt")]


def test_entry_works_without_a_library_that_optional_parts_need():
    import subprocess

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'host_profile' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in (*q, *o))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False, timeout=120).returncode == 0


def test_options_from_the_environment():
    from rillweave.options import Options, from_environment

    assert from_environment({"OTHER": "1"}) == Options()
    got = from_environment({"RILLWEAVE_MAX_TOKENS": "9", "RILLWEAVE_REFILL_RATE": "0.25", "RILLWEAVE_RESPECT_ROBOTS": "No", "RILLWEAVE_EXPORT_FOLDER": "x"})
    assert (got.max_tokens, got.refill_rate, got.respect_robots, got.export_folder) == (9, 0.25, False, "x")
    for name, value in (("MAX_TOKENS", "many"), ("RESPECT_ROBOTS", "perhaps"), ("WORKERS", "0")):
        with pytest.raises(ValueError):
            from_environment({f"RILLWEAVE_{name}": value})


def test_some_fields_are_those_of_the_whole_record():
    page = '<html><head><title>T</title><meta name="description" content="d"></head><body><h1>H</h1><nav><div class="product"><h2>gone</h2></div></nav><div class="quote"><span class="text">q</span></div><div class="product-card x"><h3>a</h3><b class="Price">1</b></div><a href="http://x">x</a></body></html>'
    whole = html.page_record(page)
    assert whole["products"] == [dict.fromkeys(html.PODS.fields) | {"name": "a", "price": "1"}] and whole["quotes"] == [{"text": "q", "author": None, "author_url": None, "tags": None}]
    for some in ({"title"}, {"links"}, {"products_count"}, {"quotes", "text_length"}, {"text_preview", "h1", "links_count"}):
        got = html.page_record(page, some)
        assert {k: whole[k] for k in got} == got and some <= set(got)
    with pytest.raises(ValueError, match="page_record"):
        html.extract(F.col("x"), lambda p: {}, "a string, parse_error string", fields=["a"])
