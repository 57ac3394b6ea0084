"""Link discovery on a stream of pages: each url stays with the first source that linked it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import strip
from ..functions.urls import is_junk
from ..operators.html import parsed

OUT = "url string, discovered_from string, source_title string, fetched_at timestamp"
LINKS = "url string, ord long, pos int, source string, source_title string, fetched_at timestamp, seen timestamp"


def _firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of an Arrow batch's links of one url the first, so that a url which many pages link is sent a few times only."""
    for pdf in batches:
        latest = pdf.groupby("url")["fetched_at"].transform("max")
        yield pdf.assign(seen=latest).sort_values(["ord", "pos"]).drop_duplicates("url")[["url", "ord", "pos", "source", "source_title", "fetched_at", "seen"]]


def discovered(pages: DataFrame, horizon: str = "30 days", late: str = "1 day") -> DataFrame:
    """url, discovered_from, source_title, fetched_at of urls that a stream of pages (ord, url, html, fetched_at[,
    status_code]) links for the first time.

    What comes in an earlier micro-batch is first; in one batch, the page of the
    smaller ord, then the earlier link. Pages without html or with another status
    than 200 link nothing; junk is left out; a title that is blank is Unknown. Pages
    with a null fetched_at, or further behind the latest one than `late`, are not
    looked at. State is one row for each url that was linked within `horizon` of
    event time; one that no page links for that long is forgotten, and is new when
    it is linked again. Links are thinned out before they are shuffled by url.
    """
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    x = pages.where((F.coalesce(F.col("html"), F.lit("")) != "") & (status == 200) & F.col("fetched_at").isNotNull())
    x = parsed(x.select("ord", F.col("url").alias("source"), F.col("url"), "html", F.col("fetched_at").cast("timestamp").alias("fetched_at")), "links_all", "title")
    title = F.coalesce(F.nullif(strip(F.col("page.title")), F.lit("")), F.lit("Unknown"))
    links = x.select("ord", "source", title.alias("source_title"), "fetched_at", F.posexplode("page.links_all").alias("pos", "url")).where(~is_junk(F.col("url")))
    links = links.select("url", F.col("ord").cast("long").alias("ord"), "pos", "source", "source_title", "fetched_at").mapInPandas(_firsts, LINKS)
    keep = int(pd.Timedelta(horizon).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, latest = None, 0
        for pdf in batches:
            latest = max(latest, int(pdf["seen"].max().timestamp() * 1000))
            row = pdf.sort_values(["ord", "pos"]).iloc[0]
            if best is None or (row["ord"], row["pos"]) < (best["ord"], best["pos"]):
                best = row
        # a url whose time is up may get links before its state is called for that
        before = state.get[0] if state.exists else None
        new = before is None or best["fetched_at"].timestamp() * 1000 > before + keep
        latest = latest if new else max(latest, before)
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest + keep, state.getCurrentWatermarkMs() + 1))
        if new:
            yield pd.DataFrame([(best["url"], best["source"], best["source_title"], best["fetched_at"])], columns=["url", "discovered_from", "source_title", "fetched_at"])

    return links.withWatermark("fetched_at", late).groupBy("url").applyInPandasWithState(step, OUT, "seen long", "append", GroupStateTimeout.EventTimeTimeout)
