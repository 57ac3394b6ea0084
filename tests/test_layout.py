import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import discovery, layout, order, registry, sitemap


def test_the_index_finds_what_a_scan_finds_and_reads_less(spark, tmp_path):
    r = random.Random(5)
    urls = [f"https://Host{r.randrange(9)}.org/{''.join(r.choice('abcdeÉ%_') for _ in range(r.randrange(12)))}" for _ in range(600)] + ["https://e.org/50%25_A", "x", "", None, "https://e.org/50%25_A"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        layout.write_url_index(df, path)
        every = df.where("url is not null").distinct()
        for q in ["abc", "HOST3.org", "50%25_a", "é%", "cd", "", "x", "https://", "zzz", "host1.org/a", "ébc", "org/"]:
            assert sorted(x.url for x in layout.search_index(spark, path, q).collect()) == sorted(x.url for x in discovery.search(every, q).collect()), q
        found = layout.search_index(spark, path, "host3.org/ab")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "dynamicpruning" in plan.lower().replace(" ", "")
        shards = len([d for d in os.listdir(f"{path}/postings") if d.startswith("shard=")])
        asked = spark.range(1).select(layout.grams(F.lit("host3.org/ab"))).first()[0]
        n = {x.gram: x.n for x in spark.read.parquet(f"{path}/counts").collect()}
        rare = sorted(asked, key=lambda g: (n[g], g))[: layout.LOOKED_UP]
        touched = {x.shard for x in spark.read.parquet(f"{path}/shards").collect() if any(x.low <= g <= x.high for g in rare)}
        assert len(touched) < shards and all(f"IN ({','.join(map(str, sorted(touched)))})".replace(" ", "") in plan.replace(" ", "") or str(t) in plan for t in touched)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pages_read_one_bucket_and_progress_needs_no_shuffle(spark, tmp_path):
    names = [f"d{i}.org" for i in range(10)]
    urls = [(f"https://{n}/{i}", n, "2024", None if i % 4 == 0 else i % 3 / 10, "daily", i % 5 == 0) for n in names for i in range(12)]
    u = spark.createDataFrame(urls, "url string, domain string, last_modified string, priority double, change_frequency string, scraped boolean")
    s = spark.createDataFrame([(n, f"https://{n}/s.xml", "", None, 12, "success", None) for n in [*names, "none.org"]], registry.SITEMAPS)
    laid_s, laid_u = layout.write_registry(s, u, "laid", 8, str(tmp_path))
    page, want = registry.get_urls(laid_u, "d3.org", 5, 2, unscraped_only=True), registry.get_urls(u, "d3.org", 5, 2, unscraped_only=True)
    assert [r.url for r in page.collect()] == [r.url for r in want.collect()]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # plans tell of buckets only then
    try:
        page = registry.get_urls(spark.table("laid_urls"), "d3.org", 5)
        assert "SelectedBucketsCount: 1 out of 8" in page._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry.domain_progress(laid_s, laid_u)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, registry.domain_progress(s, u).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for t in ("laid_sitemaps", "laid_urls"):
        spark.sql(f"DROP TABLE {t}")


ODD = {
    "index.xml": "<sitemapindex><sitemap><loc>https://e.org/c.xml</loc></sitemap></sitemapindex>",
    "cut.xml": "<urlset><url><loc>https://e.org/1</loc></url><url><loc>https://e.org/2",
    "prefix.xml": '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://e.org/p</s:loc></s:url></s:urlset>',
    "nested.xml": "<urlset><url><loc>https://e.org/1</loc></url><x><url><loc>https://e.org/2</loc></url></x></urlset>",
    "bad.xml": "<urlset><url><loc>https://e.org/1</loc></url><url><loc>a & b</loc></url></urlset>",
    "after.xml": "<urlset><url><loc>https://e.org/1</loc></url></urlset>trailing",
    "empty.xml": "",
    "none.xml": "<urlset></urlset>",
}
PLAIN = {
    "a.xml": '<?xml version="1.0"?>\n<!-- made -->\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i">\n' + "".join(f"<url>\n <loc> https://e.org/{i}?a=1&amp;b={i} </loc><lastmod>2024-01-0{i % 9 + 1}</lastmod>{'<priority>0.5</priority>' if i % 2 else '<priority> </priority>'}<image:image><image:loc>https://i/{i}</image:loc></image:image></url>\n" for i in range(500)) + "</urlset>\n",
    "b.xml": "<urlset><url><loc><![CDATA[https://e.org/c?x=1&y=2]]></loc><changefreq>daily</changefreq></url><url><lastmod>2024</lastmod></url><url id='3'><loc>https://e.org/é</loc></url></urlset>",
}


@pytest.mark.parametrize("large", [0, 1 << 30])
def test_files_read_in_parts_give_the_rows_of_whole_ones(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(order, "SLICE", 32)
    for name, text in (ODD | PLAIN).items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = sitemap.read_sitemaps(spark, str(tmp_path), large).collect()
        parts = spark.read.option("lineSep", "</url>").text(str(tmp_path / "a.xml")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 10
    got = {n: [(r.kind, r.url, r.last_modified, r.priority, r.change_frequency) for r in sorted(rows, key=lambda r: r.ord) if r.sitemap_url.endswith("/" + n)] for n in ODD | PLAIN}
    for n, text in (ODD | PLAIN).items():
        assert got[n] == [(e["kind"], e["url"], e["last_modified"], e["priority"], e["change_frequency"]) for e in sitemap.entries(text.encode())], n
