import datetime as dt
import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls as ur
from pagemill.operators import classify, discovery, format, html, registry, research, search, sitemap
from pagemill.sources import captures

NOW = dt.datetime(2024, 1, 10)


def settled(*tables):
    """The tables as a caller would write and read them between merges."""
    return [t.sparkSession.createDataFrame(t.collect(), t.schema) for t in tables]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.integers(0, 6000), st.booleans()), min_size=1, max_size=20))
def test_outcome_is_total(spark, cases):
    df = spark.createDataFrame([(i, t * (n // max(1, len(t))), t, e) for i, (t, n, e) in enumerate(cases)], "i int, content string, title string, e boolean")
    for _ in range(2):
        rows = classify.with_outcome(df, encoding_error="e").collect()
        assert all(r.status in classify.STATUSES and r.confidence in ("high", "medium") for r in rows)


URLSET = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.org/1 </loc><priority>0.5</priority></url><url><lastmod>x</lastmod></url><url><loc>https://e.org/2</loc><lastmod>2024</lastmod><changefreq>daily</changefreq></url></urlset>'
INDEX = "<sitemapindex><sitemap><loc>https://e.org/c1.xml</loc></sitemap><sitemap><loc>https://e.org/gone.xml</loc></sitemap></sitemapindex>"


def test_sitemap_entries():
    got = sitemap.entries(URLSET.encode())
    assert [(e["kind"], e["url"], e["priority"], e["last_modified"], e["change_frequency"]) for e in got] == [("url", "https://e.org/1", 0.5, None, None), ("url", "https://e.org/2", None, "2024", "daily")]
    assert [e["url"] for e in sitemap.entries(URLSET.replace(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"', "").encode())] == ["https://e.org/1", "https://e.org/2"]
    assert [(e["kind"], e["url"]) for e in sitemap.entries(INDEX.encode())] == [("sitemap", "https://e.org/c1.xml"), ("sitemap", "https://e.org/gone.xml")]
    assert sitemap.entries(b"<broken") == [] and sitemap.entries(None) == []
    with pytest.raises(ValueError):
        sitemap.entries(b"<urlset><url><loc>x</loc><priority>high</priority></url></urlset>")


def test_registry_lifecycle(spark, tmp_path):
    caps = spark.createDataFrame([("https://e.org/sitemap_index.xml", INDEX.encode()), ("https://e.org/c1.xml", URLSET.encode()), ("https://f.org/sitemap.xml", b"<broken")], "url string, content binary")
    domains = spark.createDataFrame([("https://www.E.org",), ("f.org",), ("g.org",)], "domain string")
    s, u = registry.add_domain(registry.empty(spark, registry.SITEMAPS), registry.empty(spark, registry.URLS), domains, caps, now())
    s, u = settled(s, u)
    rows = {r.domain: r for r in s.collect()}
    assert (rows["e.org"].status, rows["e.org"].url_count, rows["e.org"].error_message) == ("success", 2, None)
    assert (rows["f.org"].status, rows["f.org"].sitemap_url, rows["g.org"].status) == ("failed", "", "failed")
    assert sorted(r.url for r in u.collect()) == ["https://e.org/1", "https://e.org/2"]
    s2, u2 = registry.refresh(s, u, spark.createDataFrame([("e.org",)], "domain string"), caps, now())
    s2, u2 = settled(s2, u2)
    assert u2.count() == 2 and s2.count() == 3
    log = registry.mark_scraped(registry.empty(spark, registry.SCRAPED), u, spark.createDataFrame([("https://e.org/1",), ("https://x/",)], "url string"), now())
    (log,) = settled(log)
    assert [(r.url, r.scraped) for r in registry.with_scraped(u, log).orderBy("url").collect()] == [("https://e.org/1", True), ("https://e.org/2", False)]
    pages = spark.createDataFrame([("https://e.org/2", "<article>hello</article>")], "url string, html string")
    docs, log = registry.scrape_from_sitemap(s, u, log, pages, "e.org", NOW)
    assert [r.content for r in docs.collect()] == ["hello"] and log.count() == 2
    later = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    s3, u3 = registry.refresh_stale(s, u, caps, later)
    s3, u3 = settled(s3, u3)
    assert u3.count() == 2 and {r.last_fetched.month for r in s3.collect()} == {2}
    docs, _ = registry.scrape_from_sitemap(registry.empty(spark, registry.SITEMAPS), registry.empty(spark, registry.URLS), registry.empty(spark, registry.SCRAPED), pages, "e.org", NOW, captures=caps)
    assert [r.content for r in docs.collect()] == ["hello"]


def test_gzipped_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(URLSET.encode()))
    (tmp_path / "b.xml").write_bytes(URLSET.encode())
    assert sitemap.parsed(sitemap.read_files(spark, str(tmp_path))).count() == 4


def test_stale_is_strict(spark):
    x = spark.createDataFrame([(1, dt.datetime(2024, 1, 3)), (2, dt.datetime(2024, 1, 2, 23, 59, 59)), (3, None)], "i int, t timestamp_ntz")
    assert [r.s for r in x.select("i", registry.is_stale(F.col("t"), now()).alias("s")).orderBy("i").collect()] == [False, True, True]


def test_discovery(spark):
    pages = spark.createDataFrame(
        [("https://a.org/", "<title> A </title><a href='/x'></a><a href='https://t.org/ads/1'></a><a href='/y'></a>", 200), ("https://b.org/", "<a href='https://a.org/x'></a><a href='/z'></a>", 200), ("https://c.org/", "<a href='/q'></a>", 404)],
        "url string, html string, status_code int",
    )
    sources = discovery.add_sources(spark.createDataFrame([], "ord long, url string"), spark.createDataFrame([(0, "b.org/"), (1, "https://a.org/"), (2, "https://c.org/"), (3, " https://b.org/")], "ord long, url string"))
    assert [r.url for r in sources.orderBy("ord").collect()] == ["https://b.org/", "https://a.org/", "https://c.org/"]
    have = spark.createDataFrame([("https://a.org/y", "s", "t", "n")], captures.DISCOVERED)
    new, counters = discovery.discover(sources, pages, have, F.lit("2024"))
    assert {(r.url, r.discovered_from, r.source_title) for r in new.collect()} == {("https://a.org/x", "https://b.org/", "Unknown"), ("https://b.org/z", "https://b.org/", "Unknown")}
    assert {(r.source, r.new, r.junk) for r in counters.collect()} == {("https://b.org/", 2, 0), ("https://a.org/", 0, 1)}
    again, _ = discovery.discover(sources, pages, have.unionByName(new), F.lit("2025"))
    assert again.count() == 0


def test_search_results_page(spark):
    html = '<div class="result__body x"><a class="result__a" href="//d?uddg=https%3A%2F%2Fe.org%2Fa%2Bb+c&x=1">The <b>title</b></a><a class="result__snippet">sn</a></div><div class="result__body"></div>'
    x = spark.createDataFrame([("q", html)], "query string, html string").select("query", F.explode(search.parse_results("html")).alias("r")).select("query", "r.*")
    got = search.positions(x).collect()
    assert [(r.position, r.title, r.url, r.snippet) for r in got] == [(1, "Thetitle", "https://e.org/a+b+c", "sn")]


def test_cache_lookup_edges(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("Q ", 10, t, True), ("f", 10, t, False)], "query string, num_results int, ts timestamp_ntz, success boolean")
    asks = [("q", 10, 299, True), ("q", 10, 300, False), ("q", 10, 301, False), ("q", 5, 1, False), ("f", 10, 1, False), (" q", 10, 0, True)]
    r = spark.createDataFrame([(q, n, t + dt.timedelta(seconds=s)) for q, n, s, _ in asks], "query string, num_results int, ts timestamp_ntz")
    got = {(x.query, x.num_results, (x.ts - t).seconds): x.hit for x in search.lookup(e, r).collect()}
    assert got == {(q, n, s): h for q, n, s, h in asks}


def test_research_keeps_failures_apart(spark):
    caps = spark.createDataFrame([("u1", "<title>T</title><article>" + "word " * 200 + "</article>", 200, False), ("u2", "<article>captcha</article>", 403, False), ("u3", None, 0, False), ("u4", "<article>x</article>", 200, True)], "url string, html string, status_code int, encoding_error boolean")
    serp = spark.createDataFrame([("q", i, f"u{i}", f"t{i}", "s") for i in range(1, 6)] + [("q", 6, "", "t", "s")], "query string, position int, url string, title string, snippet string")
    rows = research.joined(serp, research.retrieve(caps), 100)
    assert {(r.url, r.title) for r in research.sources(rows).collect()} == {("u1", "T")}
    assert {(r.url, r.status) for r in research.failures(rows).collect()} == {("u2", "blocked"), ("u3", "empty"), ("u4", "encoding-failure"), ("u5", "error")}
    m = research.metrics(rows).first()
    assert (m.total, m.usable_count, m.usable_rate, m.blocked_count, m.thin_count) == (5, 1, 0.2, 1, 0)


def test_routed_takes_the_other_capture(spark):
    static = spark.createDataFrame([("https://e.org/", "a" * 200), ("https://e.org/s", "short"), ("https://x.com/", "b" * 300)], "url string, content string")
    other = spark.createDataFrame([("https://e.org/s", "rendered"), ("https://x.com/", "rendered")], "url string, content string")
    got = {r.url: (r.route, r.content[:8]) for r in research.routed(static, other).collect()}
    assert got == {"https://e.org/": ("static", "aaaaaaaa"), "https://e.org/s": ("fallback_javascript", "rendered"), "https://x.com/": ("javascript", "rendered")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# no\n\n  https://a.org  \n #kept\n")
    assert [r.url for r in captures.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.org", "#kept"]
    (tmp_path / "d.json").write_text(json.dumps({"u": {"discovered_from": "s", "timestamp": "t", "source_title": "n"}}, indent=1))
    assert captures.discovered_json(spark, str(tmp_path / "d.json")).collect()[0] == ("u", "s", "t", "n")
    (tmp_path / "bad.json").write_text("{")
    assert captures.discovered_json(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "s.json").write_text('["a", "b"]')
    assert [tuple(r) for r in captures.sources_json(spark, str(tmp_path / "s.json")).collect()] == [(0, "a"), (1, "b")]
    df = spark.createDataFrame([("é😀", None)], "a string, b int")
    assert json.loads(format.as_json(df, ascii_only=True).first().value) == {"a": "é😀", "b": None}
    assert format.as_json(df, ascii_only=True).first().value.isascii()
    format.write_text_files(spark.createDataFrame([("k", "text")], "key string, text string"), "key", "text", str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        format.write_text_files(spark.createDataFrame([("k", "text")], "key string, text string"), "key", "text", str(tmp_path / "out"))


def test_text_functions(spark):
    x = spark.createDataFrame([("\t a b\n",)], "t string")
    assert x.select(tx.strip(F.col("t"))).first()[0] == "a b"
    row = spark.range(1).select(tx.extract(F.lit("é123-456-7890 1234567890"), "phones").alias("p"), tx.extract(F.lit(None).cast("string"), "emails").alias("e"), tx.extract(F.lit("x"), "").alias("n"), ur.clean_filename(F.lit("https://www.e.org/a/b c.html/"), F.lit("20240101")).alias("f")).first()
    assert (row.p, row.e, row.n, row.f) == (["1234567890"], [], [], "eorg_a_b_chtml_20240101")


def test_captures_are_read_with_their_schema(spark, tmp_path):
    rows = [("https://e.org/", "<p>x</p>", 200, "static", False, None), ("https://e.org/gone", None, 0, "static", None, None)]
    spark.createDataFrame(rows, captures.CAPTURES).write.parquet(str(tmp_path / "c"))
    x = captures.captures(spark, str(tmp_path / "c"))
    assert [f.name for f in x.schema] == ["url", "html", "status_code", "method", "encoding_error", "fetched_at"] and x.count() == 2
    got = {r.url: (r.content, r.status_code) for r in html.scrape(x).collect()}
    assert got == {"https://e.org/": ("x", 200), "https://e.org/gone": (None, 0)}


def test_quick_wrappers_and_settled_tables(spark, tmp_path):
    files = spark.createDataFrame([("https://e.org/sitemap.xml", b"<urlset><url><loc>https://e.org/1</loc></url><url><loc>https://e.org/2</loc></url></urlset>")], "url string, content binary")
    none = [registry.empty(spark, s) for s in (registry.SITEMAPS, registry.URLS)]
    s, u = registry.quick_add_domain(*none, files, "https://www.e.org/x", dt.datetime(2024, 1, 1))
    assert [(r.domain, r.url_count, r.status) for r in s.collect()] == [("e.org", 2, "success")]
    assert registry.quick_get_urls(u, "e.org", 1) == ["https://e.org/1"] and registry.quick_get_urls(u, "none") == []
    wrote = []

    def settled(df):
        path = str(tmp_path / f"t{len(wrote)}")
        df.write.parquet(path)
        wrote.append(path)
        return spark.read.parquet(path)

    names = spark.createDataFrame([("e.org", "https://e.org/sitemap.xml"), ("e.org", "https://e.org/b.xml")], "domain string, sitemap_url string")
    both = files.union(spark.createDataFrame([("https://e.org/b.xml", b"<urlset><url><loc>https://e.org/b</loc></url></urlset>")], files.schema))
    s, u = registry.add_domain(*none, names, both, F.lit(dt.datetime(2024, 1, 1)), settled)
    assert [r.sitemap_url for r in s.collect()] == ["https://e.org/b.xml"] and [r.url for r in u.collect()] == ["https://e.org/b"] and len(wrote) == 2


def test_fallback_answers_by_the_first_source_that_has_results(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query string, url string")
    got, failed = search.first_source(spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "query string"), {"cache": rows(("a", "1"), ("x", "9")), "library": rows(("a", "2"), ("b", "3"), ("b", "4"))})
    assert {(r.query, r.url, r.answered_by) for r in got.collect()} == {("a", "1", "cache"), ("b", "3", "library"), ("b", "4", "library")}
    assert [tuple(r) for r in failed.collect()] == [("c", "All search methods failed")]


def test_cache_slices_agree_with_all_pairs(spark):
    t = dt.datetime(2024, 1, 1)
    e = [("q", 10, t + dt.timedelta(seconds=s), ok) for s, ok in ((0, True), (250, False), (290, True), (1000, True), (1200, True))]
    r = [(i, " Q ", 10, t + dt.timedelta(seconds=s)) for i, s in enumerate((-1, 0, 299, 300, 301, 589, 590, 599, 600, 1300, 1499, 1500, 5000))]
    entries = spark.createDataFrame(e, "query string, num_results int, ts timestamp_ntz, success boolean")
    got = {x.i: x.hit for x in search.lookup(entries, spark.createDataFrame(r, "i int, query string, num_results int, ts timestamp_ntz"), keep=("i",)).collect()}
    want = {i: any(ok and 0 <= (ts - made).total_seconds() < 300 for _, _, made, ok in e) for i, _, _, ts in r}
    assert got == want


def test_a_url_captured_twice_has_one_answer(spark):
    from pagemill.streaming import worker

    day = lambda n: dt.datetime(2024, 1, n)
    good, wall = "<title>T</title><article>" + "word " * 200 + "</article>", "<article>captcha</article>"
    rows = [("u1", wall, day(1)), ("u1", good, day(3)), ("u1", good, day(3)), ("u1", None, day(5)), ("u2", good, None), ("u2", wall, None), ("u3", wall, day(4)), (None, good, day(1))]
    caps = spark.createDataFrame(rows, "url string, html string, fetched_at timestamp_ntz")
    asks = [("q", 1, "u1", 2), ("q", 2, "u1", 3), ("q", 3, "u1", 4), ("q", 4, "u1", 9), ("q", 5, "u3", 1), ("q", 6, "u4", 9), ("q", 7, "u1", None), ("q", 8, "", 1), ("q", 9, None, 1)]
    serp = spark.createDataFrame([(q, p, u, "t", "s", n and day(n)) for q, p, u, n in asks], "query string, position int, url string, title string, snippet string, at timestamp_ntz")
    got = {r.position: r.status for r in research.answered(serp, caps, at="at").collect()}
    assert got == {1: "blocked", 2: "usable", 3: "usable", 4: "empty", 5: "blocked", 6: "error", 7: "empty"}
    plain = research.joined(serp.where("position in (1, 5)"), research.retrieve(caps), 100)
    assert plain.count() == 2 and research.metrics(plain).first().total == 2
    assert research.search_and_scrape(serp.where("position = 1"), research.retrieve(caps)).count() == 1
    assert research.compare_methods(html.scrape(caps), html.scrape(caps)).where("url is not null").count() == 3
    assert research.routed(html.scrape(caps.where("url = 'u3'")), html.scrape(caps)).count() == 1
    ask = spark.createDataFrame([('{"tool": "%s", "args": {"url": "u1", "query": "q"}}' % t,) for t in ("retrieve_source", "extract_urls", "research_with_sources")], "value string")
    r = worker.requests(ask)
    handlers = worker.tools(serp.drop("at"), caps)
    assert [handlers[t](r.where(F.col("tool") == t)).count() for t in ("retrieve_source", "extract_urls", "research_with_sources")] == [1, 1, 1]


def test_only_captures_that_answer_are_parsed(spark):
    caps = spark.createDataFrame([("u1", "<p>a</p>")], "url string, html string")
    serp = spark.createDataFrame([("q", 1, "u1", "t", "s")], "query string, position int, url string, title string, snippet string")
    plan = research.answered(serp, caps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")
