import datetime as dt
import random

import pytest

from pagemill.operators import cache, order

T0 = dt.datetime(2024, 1, 1)


def sequential(rows, ttl, capacity):
    """The cache asked for one request after the other."""
    live, out = {}, {}
    for i, query, n, ts, ok in sorted(rows, key=lambda r: (r[3] is not None, r[3] or T0, r[0])):
        if ts is None or query is None or n is None:
            out[i] = (False, False)
            continue
        key = f"{query.strip().lower()}:{n}"
        hit = key in live and (ts - live[key]).total_seconds() < ttl
        if not hit:
            live.pop(key, None)
        made = not hit and bool(ok)
        if made:
            if capacity is not None and len(live) >= capacity:
                del live[min(live, key=live.get)]
            live[key] = ts
        out[i] = (hit, made)
    return out


def log(n, keys, seconds, seed):
    r = random.Random(seed)
    hot = lambda: "Hot" if r.random() < 0.4 else f"k{r.randrange(keys)}"
    rows = [(i, r.choice(["", " "]) + hot(), 10, T0 + dt.timedelta(microseconds=r.randrange(seconds * 10**6)), r.random() < 0.8) for i in range(n)]
    return rows + [(n, None, 10, T0, True), (n + 1, "hot", None, T0, True), (n + 2, "hot", 10, None, True), (n + 3, "hot", 10, T0, None)]


@pytest.mark.parametrize(("n", "keys", "seconds", "ttl", "capacity"), [(400, 8, 20_000, 300, 5), (300, 40, 4_000, 900, 5), (300, 3, 3_000, 200, None), (250, 200, 900, 300, 20)])
def test_replay_is_the_sequential_one(spark, monkeypatch, n, keys, seconds, ttl, capacity):
    monkeypatch.setattr(order, "SLICE", 16)
    rows = log(n, keys, seconds, n + keys)
    df = spark.createDataFrame(rows, "request_id long, query string, num_results int, ts timestamp_ntz, success boolean")
    got = {r.request_id: (r.hit, r.made) for r in cache.replay(df, ttl, capacity).collect()}
    want = sequential(rows, ttl, capacity)
    assert got == want and any(h for h, _ in want.values())


def written_by_replay(spark, monkeypatch, rows, ttl, capacity):
    """How many tables the replay of rows writes, which is right."""
    names = []
    monkeypatch.setattr(cache, "written", lambda df, name, real=cache.written: (names.append(name), real(df, name))[1])
    df = spark.createDataFrame(rows, "request_id long, query string, num_results int, ts timestamp_ntz, success boolean")
    got = {r.request_id: (r.hit, r.made) for r in cache.replay(df, ttl, capacity).collect()}
    assert got == sequential(rows, ttl, capacity)
    return len(names)


def test_evictions_that_decide_about_evictions_take_few_rounds(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, f"k{r.randrange(12)}", 10, T0 + dt.timedelta(seconds=i), r.random() < 0.8) for i in range(800)]
    assert written_by_replay(spark, monkeypatch, rows, 86_400, 4) <= 16


@pytest.mark.parametrize("capacity", [100, None])
def test_one_long_chain_of_entries_takes_few_rounds(spark, monkeypatch, capacity):
    rows = [(i, "hot", 10, T0 + dt.timedelta(seconds=i), True) for i in range(1500)]
    assert written_by_replay(spark, monkeypatch, rows, 3, capacity) <= 10


@pytest.mark.parametrize("capacity", [5, None])
def test_little_is_replayed_twice(spark, monkeypatch, capacity):
    """Each part of the log goes on from block to block, so only where parts meet does a block begin otherwise."""
    monkeypatch.setattr(order, "SLICE", 64)
    counts = []
    monkeypatch.setattr(cache, "_ends", lambda log, *rest, real=cache._ends: (counts.append(log.count()), real(log, *rest))[1])
    rows = log(4000, 8, 80_000, 5)
    df = spark.createDataFrame(rows, "request_id long, query string, num_results int, ts timestamp_ntz, success boolean")
    got = {r.request_id: (r.hit, r.made) for r in cache.replay(df, 300, capacity).collect()}
    assert got == sequential(rows, 300, capacity)
    assert sum(counts) < len(rows) / 4


def test_replay_of_no_requests(spark):
    assert cache.replay(spark.createDataFrame([], "request_id long, query string, num_results int, ts timestamp, success boolean")).count() == 0


@pytest.mark.parametrize("forward", [True, False])
def test_nearest_over_slices(spark, monkeypatch, forward):
    monkeypatch.setattr(order, "SLICE", 4)
    r = random.Random(4)
    events = [(r.choice("aab"), r.randrange(60), i) for i in range(40)]
    probes = [(r.choice("aabc"), r.randrange(60), -1 - i) for i in range(80)]
    e, p = spark.createDataFrame(events, "k string, t int, e int"), spark.createDataFrame(probes, "k string, t int, p int")
    got = {x.p: None if x.found is None else x.found.t for x in order.nearest(e, p, "k", ["t"], ["t"], forward).collect()}
    for k, t, i in probes:
        there = [u for j, u, _ in events if j == k and (u > t if forward else u < t)]
        assert got[i] == ((min if forward else max)(there) if there else None)


def test_running_sums_over_slices(spark, monkeypatch):
    monkeypatch.setattr(order, "SLICE", 4)
    x = order.placed(spark.range(100).selectExpr("id", "id % 3 AS k"), "id")
    got = {r.id: r.s for r in order.running_sum(x, order.F.col("id"), "s", ("k",)).collect()}
    assert got == {i: sum(j for j in range(i + 1) if j % 3 == i % 3) for i in range(100)}


def test_delays_follow_failures_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(order, "SLICE", 8)
    r = random.Random(9)
    rows = [(i, r.choice(["hot", "hot", "a", None]), None if r.random() < 0.05 else T0 + dt.timedelta(seconds=r.randrange(90)), r.choice([True, False, False, None])) for i in range(300)]
    got = {x.request_id: (x.failures, x.delay) for x in cache.delays(spark.createDataFrame(rows, "request_id long, who string, ts timestamp_ntz, success boolean"), "who", keep=()).collect()}
    failed, want = {}, {}
    for i, who, _, ok in sorted(rows, key=lambda x: (x[2] is not None, x[2] or T0, x[0])):
        n = failed.get(who, 0)
        want[i] = (n, min(2.0**n, 30.0))
        failed[who] = 0 if ok else n + 1
    assert got == want
