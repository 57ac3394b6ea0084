"""Places, prefix sums and neighbours in a sorted order, without a window over a whole key.

Rows are range-sorted over all keys, which gives each its place; places are cut
into slices of SLICE rows; a window works within a slice, and what it needs from
other slices comes from one row for each slice. So a key with any share of all
rows is dealt over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Rows of a slice, a power of two.
SLICE = 1 << 14


def placed(df: DataFrame, *order: str | Column, place: str = "place") -> DataFrame:
    """df and each row's place in this order: increasing, with gaps. Rows that the order
    doesn't tell apart stand in any order, so a result should be written before it is read twice."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn(place, F.monotonically_increasing_id())


def slice_of(place: str = "place", rows: int | None = None) -> Column:
    return F.shiftright(F.col(place), (rows or SLICE).bit_length() - 1)


def blocks(slices: DataFrame) -> DataFrame:
    """_slice and _block of slices (_slice, _n: their rows): slices one after the other, up to SLICE rows or a slice more, so
    that short slices make no block of their own."""
    # a row for each slice
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select("_slice", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / SLICE).alias("_block"))


def running_sum(df: DataFrame, value: Column, name: str, by: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """df and the sum of value over the rows of the same `by` up to and with each row, by place."""
    x = df.withColumn("_slice", slice_of(place)).withColumn("_value", value)
    sums = x.groupBy(*by, "_slice").agg(F.sum("_value").alias("_sum"))
    # a row for each slice
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_slice").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_inside", F.sum("_value").over(inside)).join(sums, same)
    return x.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def nearest(events: DataFrame, probes: DataFrame, key: str, order: list[str], take: list[str], forward: bool) -> DataFrame:
    """probes with the columns `take` (a struct, `found`) of the nearest event of the same key
    behind the probe in `order`, or before it; null where there is none. An event at the
    probe's very place counts as before it when looking forward, and as behind it when
    looking back, so it is found by neither. Null keys meet nothing."""
    found = F.struct(*[F.col(c) for c in take])
    own = [c for c in probes.columns if c != key and c not in order]
    kind = found_type(events, take)
    e = events.where(F.col(key).isNotNull()).select(key, *order, F.lit(0 if forward else 1).alias("_side"), found.alias("_event"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in own])
    p = probes.select(key, *order, F.lit(1 if forward else 0).alias("_side"), F.lit(None).cast(kind).alias("_event"), *own)
    # written, as it is read twice and places must be the same
    x = written(placed(e.unionByName(p), key, *order, "_side", place="_place").withColumn("_slice", slice_of("_place")), "nearest")
    edge = F.first if forward else F.last
    side = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    x = x.withColumn("_near", edge("_event", ignorenulls=True).over(Window.partitionBy(key, "_slice").orderBy("_place").rowsBetween(*side)))
    # the first or last event of each slice, a row for each key and slice
    by = F.min_by if forward else F.max_by
    ends = x.groupBy(key, "_slice").agg(by("_event", F.when(F.col("_event").isNotNull(), F.col("_place"))).alias("_end"))
    ends = ends.withColumn("_far", edge("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_slice").rowsBetween(*side)))
    ends = ends.where("_far is not null").select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), "_far")
    x = x.where(F.col("_side") == (1 if forward else 0)).join(ends, (F.col(key) == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    return x.select(*probes.columns, F.coalesce("_near", "_far").alias("found"))


def found_type(events: DataFrame, take: list[str]):
    return events.select(F.struct(*take).alias("x")).schema["x"].dataType
