"""Which requests of a log a cache of bounded age and size answers.

The cache holds an entry for each key that a successful request made which it
could not answer; an answered request leaves the entry as it is. An entry answers
for less than ttl seconds, and until as many others as the cache may hold have
been made after it: when a new one finds the cache full, the oldest goes. (What
has expired is older than anything alive, so it never costs a living entry its
place.)

The log is sorted into its order and replayed where it stands, each part of it first as
if the cache were empty before it. It is cut into blocks, and what is alive at each
block's end is kept. A block that began with other entries than the one before it has
left (the first of each part, at first) is replayed again, until none did. Then every
block has begun as in the sequential replay. What a block began with is mostly
forgotten at its end, as entries expire or are evicted, so few rounds are needed, each
over few blocks; at worst, where a difference goes on through the whole log, there are
as many rounds as blocks.

With a capacity the order is time, and no more than `capacity` entries go from block
to block. Without one keys are independent: the order is key, then time, and the one
entry that goes on is that of the key in which a block ends. So no key, time or
session is gathered in one task; see `order`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_delay, cache_key
from ..tables import discard, written
from . import order as places
from .order import blocks, placed, running_sum, slice_of

TTL_SECONDS, MAX_ENTRIES = 300, 100
_HELD = "_block long, keys array<string>, ats array<long>"


def _asked(log) -> tuple[list, list, list]:
    """key, at, good of the rows of Arrow data; no key where there is no time."""
    import pyarrow.compute as pc

    timed = pc.is_valid(log["at"])
    keys = pc.if_else(timed, log["key"], None)
    return tuple(x.to_numpy(zero_copy_only=False).tolist() for x in (keys, pc.fill_null(log["at"], -(1 << 63)), log["good"]))


def _replayed(live: dict[str, int], keys, ats, good, ttl: int, capacity: int | None) -> tuple[list[bool], list[bool]]:
    """hit and made of rows, one after the other; live (key to the time of its entry, oldest first) is left as it is after them."""
    hits, makes = [], []
    for key, at, well in zip(keys, ats, good):
        since = live.get(key)
        hit = since is not None and at - since < ttl
        make = well and not hit and key is not None
        if since is not None and not hit:
            del live[key]
        if make:
            if capacity is not None and len(live) >= capacity:
                del live[next(iter(live))]
            live[key] = at
        hits.append(hit)
        makes.append(make)
    return hits, makes


def _living(live: dict[str, int], key: str | None, at: int, ttl: int, capacity: int | None) -> dict[str, int]:
    """What is alive after a row (key, at). What has expired is left out, so that blocks which differ in it alone end alike."""
    return {k: t for k, t in live.items() if at - t < ttl and (capacity is not None or k == key)}


def _through(batches, rows: int, ttl: int, capacity: int | None):
    """Arrow batches of a part of the log, in order, with hit and made; the last row of each slice of so many rows,
    and of the part, has the living entries after it."""
    import pyarrow as pa

    def done(batch, hits, makes, ends):
        new = {"hit": pa.array(hits, pa.bool_()), "made": pa.array(makes, pa.bool_())}
        new["keys"] = pa.array([None if x is None else list(x) for x in ends], pa.list_(pa.string()))
        new["ats"] = pa.array([None if x is None else list(x.values()) for x in ends], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])

    live, ready = {}, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if ready is not None:
            yield done(*ready)
        begin, hits, makes, ends, i = batch["place"][0].as_py(), [], [], [None] * n, 0
        keys, ats, good = _asked(batch)
        while i < n:
            j = min(n, i + rows - (begin + i) % rows)
            found = _replayed(live, keys[i:j], ats[i:j], good[i:j], ttl, capacity)
            hits += found[0]
            makes += found[1]
            if (begin + j) % rows == 0:
                live = _living(live, keys[j - 1], ats[j - 1], ttl, capacity)
                ends[j - 1] = dict(live)
            i = j
        ready = batch, hits, makes, ends
    if ready is not None:
        ends[-1] = _living(live, keys[-1], ats[-1], ttl, capacity)
        yield done(*ready)


def _block(log, held, ttl: int, capacity: int | None):
    """(log in order, lists of hit and made of its rows, living entries after it) of a block's Arrow tables."""
    import pyarrow.compute as pc

    log = log.take(pc.sort_indices(log["place"]))
    live = {} if not held.num_rows else dict(zip(held["keys"][0].as_py(), held["ats"][0].as_py()))
    keys, ats, good = _asked(log)
    out = _replayed(live, keys, ats, good, ttl, capacity)
    return log, out, _living(live, keys[-1], ats[-1], ttl, capacity)


def _ends(log: DataFrame, held: DataFrame, ttl: int, capacity: int | None) -> DataFrame:
    """_HELD after each block of log, which began with held."""

    def run(left, right):
        import pyarrow as pa

        live = _block(left, right, ttl, capacity)[2]
        return pa.table({"_block": left["_block"][:1], "keys": pa.array([list(live)], pa.list_(pa.string())), "ats": pa.array([list(live.values())], pa.list_(pa.int64()))})

    asks = log.select("_block", "place", "key", "at", "good")
    return written(asks.groupBy("_block").cogroup(held.groupBy("_block")).applyInArrow(run, _HELD), "cache-ends")


def replay(requests: DataFrame, ttl: int = TTL_SECONDS, capacity: int | None = MAX_ENTRIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, request_id, ts, the columns of keep, hit and made of requests (request_id, query,
    num_results, ts, success), which come in the order of ts, then request_id.

    hit: whether the cache answers the request; made: whether the request makes an
    entry. Requests without a ts come first, are never answered and make nothing; a
    null success is none; a null query or number of results has no key and is never
    answered. Repeated rows are requests of their own, in any order. Without a
    capacity, entries end by age alone.
    """
    at, age, rows = F.unix_micros(F.col("ts").cast("timestamp")), ttl * 1_000_000, places.SLICE
    x = requests.select("request_id", "ts", at.alias("at"), F.coalesce("success", F.lit(False)).alias("good"), *keep, F.col("query").alias("_query"), F.col("num_results").alias("_num_results"))
    key = cache_key(F.col("_query"), F.col("_num_results"))
    if capacity is None:
        x = placed(x.withColumn("key", key), "key", "at", "request_id")
    else:  # keys are made once, after the range sort has read its input twice
        x = placed(x, "at", "request_id").withColumn("key", key)
    x = x.drop("_query", "_num_results")
    schema = x.withColumns({"hit": F.lit(False), "made": F.lit(False), "keys": F.lit(None).cast("array<string>"), "ats": F.lit(None).cast("array<bigint>")}).schema
    log = written(x.mapInArrow(lambda batches: _through(batches, rows, age, capacity), schema), "cache-log").withColumn("_slice", slice_of())
    slices = written(log.where("keys is not null").select("_slice", (F.col("place") % rows + 1).alias("_n"), F.shiftright("place", 33).alias("_part"), "keys", "ats"), "cache-slices")
    of = written(blocks(slices), "cache-of")
    # a row for each block
    line, part = Window.orderBy("_block"), slices.select("_slice", "_part", "keys", "ats")
    ordered = of.join(slices.select("_slice", "_part"), "_slice").groupBy("_block").agg(F.max("_slice").alias("_slice"), F.min("_part").alias("_from"), F.max("_part").alias("_part"))
    after = written(ordered.select("*", F.lag("_block").over(line).alias("_before"), F.lag("_slice").over(line).alias("_last"), (F.lag("_part").over(line) == F.col("_from")).alias("_goes_on")), "cache-blocks")
    ends = after.join(part.drop("_part"), "_slice").select("_block", "keys", "ats", F.lit(False).alias("_again"))
    held = after.where("_goes_on").select("_block", F.col("_last").alias("_slice")).join(part, "_slice").select("_block", "keys", "ats")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>"))
    # a block of more than one part was not replayed in one go
    unknown = F.col("_from") != F.col("_part")
    while True:
        left = ends.select(F.col("_block").alias("_before"), "keys", "ats")
        now = written(after.join(left, "_before", "left").select("_block", empty("keys", "string").alias("keys"), empty("ats", "bigint").alias("ats"), unknown.alias("_unknown")), "cache-held")
        began = held.select("_block", F.col("keys").alias("_keys"), F.col("ats").alias("_ats"))
        differs = (F.col("keys") != empty("_keys", "string")) | (F.col("ats") != empty("_ats", "bigint"))
        other = written(now.join(began, "_block", "left").where(differs | F.col("_unknown")).select("_block", "keys", "ats"), "cache-other")
        discard(held)
        held, unknown = now, F.lit(False)
        if other.isEmpty():
            break
        again = _ends(log.join(of.join(other.select("_block"), "_block", "left_semi"), "_slice"), other, age, capacity)
        last, ends = ends, written(ends.join(again.select("_block"), "_block", "left_anti").unionByName(again.withColumn("_again", F.lit(True))), "cache-ends")
        discard(last, again, other)
    columns = ["key", "request_id", "ts", *keep]

    def run(left, right):
        import pyarrow as pa

        found, out, _ = _block(left, right, age, capacity)
        found = found.select(columns)
        for name, x in zip(("hit", "made"), out):
            found = found.append_column(name, pa.array(x, pa.bool_()))
        return found

    of = of.join(ends.select("_block", "_again"), "_block")
    final = log.join(of.where(~F.col("_again")), "_slice").select(*columns, "hit", "made")
    asks = log.select("_slice", "place", "at", "good", *columns).join(of.where("_again").select("_slice", "_block"), "_slice")
    held = held.join(ends.where("_again"), "_block", "left_semi").select("_block", "keys", "ats")
    return final.unionByName(asks.groupBy("_block").cogroup(held.groupBy("_block")).applyInArrow(run, final.schema))


def delays(requests: DataFrame, key: str, base: float = 1.0, cap: float = 30.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, request_id, ts, the columns of keep, failures and delay of requests (key, request_id, ts, success):
    the failures in a row just before each request of its key, and the seconds to wait because of them.

    Requests of a key come in the order of ts, then request_id; a request without a
    ts comes first. A null key is a key; a null success is a failure. A run of failures ends with a success: it is
    numbered by the successes before it, and its failures are counted along it. Both
    are running sums over slices, so neither a key nor a run is held by one task.
    Repeated rows are requests of their own.
    """
    x = requests.select(F.col(key), "request_id", "ts", F.coalesce("success", F.lit(False)).alias("_good"), *keep)
    x = written(placed(x, F.asc_nulls_first(key), F.asc_nulls_first("ts"), "request_id"), "delays")
    good = F.col("_good").cast("long")
    x = running_sum(x, good, "_successes", (key,)).withColumn("_run", F.col("_successes") - good)
    x = running_sum(x, 1 - good, "_failures", (key, "_run"))
    failures = F.col("_failures") - (1 - good)
    return x.select(key, "request_id", "ts", *keep, failures.alias("failures"), backoff_delay(failures, base, cap).alias("delay"))
