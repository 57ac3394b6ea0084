import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import discovery as links
from pagemill.operators import registry
from pagemill.streaming import discovery, registry as stored

T0 = dt.datetime(2024, 1, 1)


def test_discovery_on_a_stream_is_that_of_all_pages(spark, tmp_path):
    r = random.Random(2)
    url = lambda i: f"https://h{i % 5}.org/p{i}"
    pages = []
    for i in range(60):
        anchors = "".join(f'<a href="{r.choice([url(r.randrange(200)), "/hot", "https://x.org/ads/1"])}"></a>' for _ in range(r.randrange(8)))
        pages.append((i, url(i), r.choice([f"<title> T{i} </title>{anchors}", f"<title> </title>{anchors}", anchors or None]), T0 + dt.timedelta(hours=i), r.choice([200, 200, 200, 404])))
    df = spark.createDataFrame(pages, "ord long, url string, html string, fetched_at timestamp, status_code int")
    for part in range(3):
        df.where(f"ord between {part * 20} and {part * 20 + 19}").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        x = discovery.discovered(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        x.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want, _ = links.discover(df.select("ord", "url"), df.select("url", "html", "status_code"), df.select("url").limit(0), F.lit("now"))
    rows = lambda x: sorted((y.url, y.discovered_from, y.source_title) for y in x.collect())
    assert rows(got) == rows(want) and got.count() > 20


def test_discovery_forgets_after_the_horizon(spark, tmp_path):
    page = lambda i, days: (i, f"https://h.org/{i}", '<a href="/x"></a>', T0 + dt.timedelta(days=days))
    for part in ([page(0, 0)], [page(1, 1)], [page(2, 20)], [page(3, 21)]):
        spark.createDataFrame(part, "ord long, url string, html string, fetched_at timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        x = discovery.discovered(spark.readStream.schema("ord long, url string, html string, fetched_at timestamp").parquet(str(tmp_path / "in")), "5 days", "1 hour")
        x.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r.discovered_from for r in spark.read.parquet(str(tmp_path / "out")).orderBy("fetched_at").collect()][0] == "https://h.org/0"
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def urlset(*urls):
    return ("<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>").encode()


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")}


def contents(store):
    return [sorted(map(repr, store.read(t).collect())) for t in ("sitemaps", "urls", "scraped")]


def test_a_batch_merged_twice_gives_the_same_tables(spark, tmp_path, monkeypatch):
    store = stored.Store(spark, str(tmp_path / "store"), 8)
    names = [f"d{i}.org" for i in range(12)]
    files = [(f"https://{n}/sitemap.xml", urlset(f"https://{n}/1", f"https://{n}/2", "https://shared.org/x")) for n in names[:10]]
    caps = spark.createDataFrame(files, "url string, content binary")
    domains = spark.createDataFrame([(n,) for n in names], "domain string")
    store.add(domains, caps, T0)
    want_s, want_u = registry.add_domain(registry.empty(spark, registry.SITEMAPS), registry.empty(spark, registry.URLS), domains, caps, F.lit(T0).cast("timestamp_ntz"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(store.read("sitemaps").drop("bucket")) == rows(want_s) and rows(store.read("urls").drop("bucket")) == rows(want_u)
    store.mark_scraped(spark.createDataFrame([("https://d1.org/1",), ("https://unknown.org/",)], "url string"), T0, 0)
    before = contents(store)
    store.add(domains, caps, T0)
    store.mark_scraped(spark.createDataFrame([("https://d1.org/1",)], "url string"), T0, 0)
    assert contents(store) == before
    # one domain more: other buckets keep their files
    files_before = files_of(tmp_path / "store" / "urls")
    more = spark.createDataFrame([("https://e.org/sitemap.xml", urlset("https://e.org/1"))], "url string, content binary")
    store.add(spark.createDataFrame([("e.org",)], "domain string"), more, T0)
    now = files_of(tmp_path / "store" / "urls")
    own = store.read("urls").where("url = 'https://e.org/1'").first().bucket
    others = lambda files: {f: t for f, t in files.items() if f"bucket={own}/" not in f}
    assert others(now) == others(files_before) and len(others(now)) > 1
    assert store.of_domain("d1.org").first().url_count == 3 and store.of_domain("none.org").isEmpty()
    assert [k for k in store.read("sitemaps").where("bucket = 3")._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in k and "bucket" in k]


def test_a_merge_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = stored.Store(spark, path, 4)
    row = lambda n, k: (n, f"https://{n}/s.xml", "", T0, k, "success", None)
    store.merge_sitemaps(spark.createDataFrame([row("a.org", 1), row("b.org", 2)], registry.SITEMAPS))
    finish = stored.Store._finish
    monkeypatch.setattr(stored.Store, "_finish", lambda self: (_ for _ in ()).throw(RuntimeError("cut")))
    with pytest.raises(RuntimeError, match="cut"):
        store.merge_sitemaps(spark.createDataFrame([row("a.org", 5), row("c.org", 3)], registry.SITEMAPS))
    monkeypatch.setattr(stored.Store, "_finish", finish)
    again = stored.Store(spark, path, 4)
    assert {r.domain: r.url_count for r in again.read("sitemaps").collect()} == {"a.org": 5, "b.org": 2, "c.org": 3}


def test_stale_domains_are_refreshed_from_arriving_files(spark, tmp_path):
    store = stored.Store(spark, str(tmp_path / "store"), 4)
    names = ["a.org", "b.org", "c.org"]
    first = spark.createDataFrame([(f"https://{n}/sitemap.xml", urlset(f"https://{n}/1")) for n in names], "url string, content binary")
    store.add(spark.createDataFrame([(n,) for n in [*names, "lost.org"]], "domain string"), first, T0)
    now, root = T0 + dt.timedelta(days=10), tmp_path / "drop"

    def put(name, *urls):
        (root / name).mkdir(parents=True, exist_ok=True)
        (root / name / "sitemap.xml").write_bytes(urlset(*urls))

    run = lambda: stored.refresh_from(store, str(root), str(tmp_path / "cp"), now)
    put("a.org", "https://a.org/1", "https://a.org/2")
    put("unasked.org", "https://unasked.org/1")
    run()
    seen = {r.domain: (r.url_count, r.last_fetched) for r in store.read("sitemaps").collect()}
    assert seen["a.org"] == (2, now) and seen["b.org"] == (1, T0) and "unasked.org" not in seen
    put("b.org", "https://b.org/1", "https://b.org/3")
    put("lost.org", "https://lost.org/1")
    run()
    s, u = registry.add_domain(registry.empty(spark, registry.SITEMAPS), registry.empty(spark, registry.URLS), spark.createDataFrame([(n,) for n in [*names, "lost.org"]], "domain string"), first, F.lit(T0).cast("timestamp_ntz"))
    both = spark.createDataFrame([(f"https://{n}/sitemap.xml", (root / n / "sitemap.xml").read_bytes()) for n in ("a.org", "b.org", "lost.org")], "url string, content binary")
    stale = spark.createDataFrame([(n,) for n in ("a.org", "b.org", "lost.org")], "domain string")
    s, u = [spark.createDataFrame(x.collect(), x.schema) for x in (s, u)]
    want_s, want_u = registry.refresh(s, u, stale, both, F.lit(now).cast("timestamp_ntz"))
    rows = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    assert rows(store.read("sitemaps"), *want_s.columns) == rows(want_s, *want_s.columns)
    assert rows(store.read("urls"), *want_u.columns) == rows(want_u, *want_u.columns)
