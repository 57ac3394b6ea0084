import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from pagemill.streaming import cache, worker

LINES = ['{"tool": "search_sources", "args": {"query": "a"}}', "", '{"tool": "web_search", "args": {"query": "b", "limit": 3}}', "{bad", '{"tool": "nope", "args": {}}', '{"tool": "scrape_url", "args": {}}', '{"tool": "extract_urls", "args": {"url": "u"}}']


def test_requests_by_batch(spark):
    got = worker.requests(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert [(r.tool, r.error) for r in got] == [("search_sources", None), ("search_sources", None), (None, "Invalid JSON"), (None, "Unknown tool: nope"), ("retrieve_source", "Missing arguments"), ("extract_urls", None)]
    assert got[1].args == {"query": "b", "limit": "3"}


def test_served_lines_equal_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("\n".join(LINES))
    handlers = {"search_sources": lambda df: df.withColumn("result", F.to_json(F.struct(F.col("args")["query"].alias("query"))))}
    worker.serve(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), handlers)
    (src / "2.txt").write_text(LINES[0])
    worker.serve(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), handlers)
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum(r["ok"] for r in got) == 3 and len(got) == 7
    assert {r["error"] for r in got if not r["ok"]} == {"Invalid JSON", "Unknown tool: nope", "Missing arguments", "No handler"}


def test_replies_keep_the_order_of_requests_through_a_failure(spark, tmp_path, monkeypatch):
    from pagemill.operators import order

    monkeypatch.setattr(order, "SLICE", 8)
    (tmp_path / "in").mkdir()
    tools = ["search_sources", "web_search", "extract_urls", "nope", "scrape_url"]

    def line(name, i):
        if i % 11 == 0:
            return "  "
        if i % 13 == 0:
            return "{broken"
        return json.dumps({"tool": tools[i % 5], "args": {"query": f"{name} {i} é", "url": f"{name} {i}"}})

    def sequential(name, n):
        out = []
        for x in (line(name, i) for i in range(n)):
            if not x.strip():
                continue
            try:
                job = json.loads(x)
            except json.JSONDecodeError:
                out.append({"ok": False, "error": "Invalid JSON"})
                continue
            if job["tool"] == "nope":
                out.append({"ok": False, "error": "Unknown tool: nope"})
            elif job["tool"] == "scrape_url":
                out.append({"ok": False, "error": "No handler"})
            else:
                out.append({"ok": True, "result": {"a": job["args"]["url" if job["tool"] == "extract_urls" else "query"]}})
        return out

    failures = [1]

    def handler(name):
        def handle(df):
            if name == "extract_urls" and failures and (tmp_path / "in" / "c.txt").exists():
                failures.pop()
                raise RuntimeError("lost")
            return df.withColumn("result", F.to_json(F.struct(F.col("args")[name == "extract_urls" and "url" or "query"].alias("a")))).orderBy(F.rand())

        return handle

    handlers = {t: handler(t) for t in ("search_sources", "extract_urls")}
    run = lambda: worker.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), handlers)
    sizes = {"a.txt": 300, "b.txt": 40, "c.txt": 150}
    put = lambda name: (tmp_path / "in" / name).write_text("\n".join(line(name, i) for i in range(sizes[name])))
    put("a.txt")
    put("b.txt")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # a file in several parts
    try:
        run()
        put("c.txt")
        with pytest.raises(Exception, match="lost"):
            run()
        run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for batch, name in ((0, "a.txt"), (0, "b.txt"), (1, "c.txt")):
        assert [json.loads(x) for x in worker.served(spark, str(tmp_path / "out"), batch, name)] == sequential(name, sizes[name])


def test_cache_stream_equals_table(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "Q", 10, t, True), (2, "q ", 10, t + dt.timedelta(seconds=299), True), (3, "q", 10, t + dt.timedelta(seconds=300), False), (4, "q", 10, t + dt.timedelta(seconds=301), True), (5, "q", 10, t + dt.timedelta(seconds=302), True), (6, "q", 5, t, True)]
    df = spark.createDataFrame(rows, "request_id long, query string, num_results int, ts timestamp, success boolean")
    table = {r.request_id: r.hit for r in cache.hits(df).collect()}
    assert table == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False}
    for i in (0, 3):  # two batches: state carries over
        df.where(f"request_id between {i + 1} and {i + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = cache.hits(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.request_id: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()} == table
