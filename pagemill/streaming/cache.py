"""The search cache on a stream: an entry for each key, alive for a fixed time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import cache_key
from ..operators.cache import TTL_SECONDS, replay

OUT = "key string, request_id long, ts timestamp, hit boolean"


def hits(requests: DataFrame, ttl: int = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """request_id, ts, key, hit of requests (request_id, query, num_results, ts, success).

    A request hits if its key's entry is younger than ttl seconds; otherwise a
    successful request makes a new entry. Works on streams and on tables alike
    (a table goes through `replay`, without a capacity);
    on a stream, requests of one batch are taken in the order of ts, those further
    behind the latest ts than `late` are not answered, and an entry's state goes
    when the time that has passed beyond that has made it older than ttl.
    """
    if not requests.isStreaming:
        return replay(requests, ttl, None).select("key", "request_id", "ts", "hit")
    x = requests.withColumn("key", cache_key(F.col("query"), F.col("num_results"))).select("key", "request_id", "ts", "success")

    def step(pdf: pd.DataFrame, made: pd.Timestamp | None) -> tuple[pd.DataFrame, pd.Timestamp | None]:
        pdf = pdf.sort_values(["ts", "request_id"])
        out = []
        for ts, ok in zip(pdf["ts"], pdf["success"]):
            hit = made is not None and (ts - made).total_seconds() < ttl
            if not hit:
                made = ts if ok else None
            out.append(hit)
        return pdf[["key", "request_id", "ts"]].assign(hit=out), made

    def stream(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made = pd.Timestamp(state.get[0]) if state.exists and state.get[0] is not None else None
        out, made = step(pd.concat(list(batches)), made)
        if made is None:
            if state.exists:
                state.remove()
        else:
            state.update((made.to_pydatetime(),))
            state.setTimeoutTimestamp(max(int(made.timestamp() * 1000) + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield out

    return x.withWatermark("ts", late).groupBy("key").applyInPandasWithState(stream, OUT, "made timestamp", "append", GroupStateTimeout.EventTimeTimeout)
