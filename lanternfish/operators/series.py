"""Time-series operators: neighbours, nearest reading, range around a probe.

A station may hold a third of all readings, so nothing is windowed by station alone. Readings
are windowed inside (station, time bucket); what crosses a bucket edge comes from one small
summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Span of the readings looked at around a probe, in hours.
HOURS_BEFORE = 12
HOURS_AFTER = 18


def _bucketed(rows: DataFrame, unit: str) -> DataFrame:
    return rows.withColumn("bucket", F.date_trunc(unit, "ts").cast("timestamp_ntz"))


def with_neighbors(readings: DataFrame, unit: str = "day") -> DataFrame:
    """Readings (station, ts, height, event_id) plus time and height of the previous and next one."""
    rows = _bucketed(readings, unit)
    here = F.struct("ts", "height")
    order = F.struct("ts", "event_id")
    inside = W.partitionBy("station", "bucket").orderBy("ts", "event_id")
    edges = rows.groupBy("station", "bucket").agg(
        F.min_by(here, order).alias("first"), F.max_by(here, order).alias("last")
    )
    across = W.partitionBy("station").orderBy("bucket")
    edges = edges.select(
        "station", "bucket", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after")
    )
    local = rows.select(
        *rows.columns, F.lag(here).over(inside).alias("_prev"), F.lead(here).over(inside).alias("_next")
    )
    joined = local.join(edges, ["station", "bucket"])
    prev, following = F.coalesce("_prev", "before"), F.coalesce("_next", "after")
    return joined.select(
        *readings.columns,
        prev["ts"].alias("prev_ts"),
        prev["height"].alias("prev_height"),
        following["ts"].alias("next_ts"),
        following["height"].alias("next_height"),
    )


def stage(prev_height: Column, next_height: Column, height: Column) -> Column:
    """Rising unless the next reading is below the previous one; an edge counts as its own neighbour."""
    return F.when(F.coalesce(next_height, height) >= F.coalesce(prev_height, height), "rising").otherwise("falling")


def _hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def _bucket_edges(mixed: DataFrame) -> DataFrame:
    """Per (station, bucket): the readings next to the bucket, before and after it.

    ``back``/``ahead`` are the nearest readings outside of the bucket, ``back2``/``ahead2`` the
    ones beyond those; empty buckets are skipped. One row per bucket.
    """
    is_reading = F.col("is_probe") == 0
    edges = mixed.groupBy("station", "bucket").agg(
        F.min_by("item", F.when(is_reading, F.struct("ts", "event_id"))).alias("first"),
        F.max_by("item", F.when(is_reading, F.struct("ts", -F.col("event_id")))).alias("last"),
        F.min_by("second", F.when(is_reading, F.struct("ts", "event_id"))).alias("after_first"),
        F.max_by("second_last", F.when(is_reading, F.struct("ts", -F.col("event_id")))).alias("before_last"),
    )
    across = W.partitionBy("station").orderBy("bucket")
    earlier, later = across.rowsBetween(W.unboundedPreceding, -1), across.rowsBetween(1, W.unboundedFollowing)
    outside = edges.select(
        "*",
        F.last("last", ignorenulls=True).over(earlier).alias("back"),
        F.first("first", ignorenulls=True).over(later).alias("ahead"),
    )
    # a bucket with a single reading continues outside of it
    filled = outside.select(
        "*",
        F.when(F.col("last").isNotNull(), F.struct(F.coalesce("before_last", "back").alias("v"))).alias("_b2"),
        F.when(F.col("first").isNotNull(), F.struct(F.coalesce("after_first", "ahead").alias("v"))).alias("_a2"),
    )
    return filled.select(
        "station",
        "bucket",
        "back",
        "ahead",
        F.last("_b2", ignorenulls=True).over(earlier)["v"].alias("back2"),
        F.first("_a2", ignorenulls=True).over(later)["v"].alias("ahead2"),
    )


def nearest_reading(
    probes: DataFrame,
    readings: DataFrame,
    payload: list[str],
    before: int = HOURS_BEFORE,
    after: int = HOURS_AFTER,
    unit: str = "day",
) -> DataFrame:
    """Per probe (station, probe_ts): ``found`` = the reading with the smallest time distance, and the
    readings ``prev`` and ``next`` around it (structs of ts and payload, or null).

    An as-of join in both directions: probes and readings are put in one time order per bucket,
    the readings before and after are looked up, and bucket summaries carry them over bucket
    edges and empty buckets. The earlier reading wins a tie; readings outside of
    [probe - before, probe + after] do not exist for the probe.
    """
    item = F.struct(F.col("ts").alias("ts"), *[F.col(c).alias(c) for c in payload])
    r = _bucketed(readings, unit).select("station", "bucket", "ts", "event_id", F.lit(0).alias("is_probe"), item.alias("item"))
    kind = r.schema["item"].dataType
    inside = W.partitionBy("station", "bucket").orderBy("ts", "event_id")
    r = r.select("*", F.lag("item").over(inside).alias("second_last"), F.lead("item").over(inside).alias("second"))
    nothing = F.lit(None).cast(kind)
    p = _bucketed(probes.withColumnRenamed("probe_ts", "ts"), unit).select(
        "station",
        "bucket",
        "ts",
        F.lit(None).cast("long").alias("event_id"),
        F.lit(1).alias("is_probe"),
        nothing.alias("item"),
        nothing.alias("second_last"),
        nothing.alias("second"),
    )
    mixed = r.unionByName(p)
    part = W.partitionBy("station", "bucket")
    # among readings at one instant the first one counts, in both directions
    back = part.orderBy("ts", "is_probe", F.col("event_id").desc()).rowsBetween(W.unboundedPreceding, 0)
    ahead = part.orderBy("ts", "is_probe", F.col("event_id").asc()).rowsBetween(1, W.unboundedFollowing)
    # each reading travels with its own neighbours in the bucket
    trio = F.when(F.col("is_probe") == 0, F.struct("item", "second_last", "second"))
    looked = mixed.select(
        "station",
        "bucket",
        "ts",
        "is_probe",
        F.last(trio, ignorenulls=True).over(back).alias("_back"),
        F.first(trio, ignorenulls=True).over(ahead).alias("_ahead"),
    ).where("is_probe = 1")
    joined = looked.join(_bucket_edges(mixed), ["station", "bucket"])
    start, end = F.col("ts") - _hours(before), F.col("ts") + _hours(after)

    def usable(reading: Column) -> Column:
        return F.when(reading["ts"].between(start, end), reading)

    # the two readings before the probe and the two after it
    b1 = F.coalesce("_back.item", "back")
    b2 = F.when(F.col("_back").isNotNull(), F.coalesce("_back.second_last", "back")).otherwise(F.col("back2"))
    a1 = F.coalesce("_ahead.item", "ahead")
    a2 = F.when(F.col("_ahead").isNotNull(), F.coalesce("_ahead.second", "ahead")).otherwise(F.col("ahead2"))
    around = joined.select(
        "station",
        F.col("ts").alias("probe_ts"),
        *[usable(c).alias(n) for n, c in (("b1", b1), ("b2", b2), ("a1", a1), ("a2", a2))],
    )
    gap_back = F.timestamp_diff("MICROSECOND", F.col("b1.ts"), F.col("probe_ts"))
    gap_ahead = F.timestamp_diff("MICROSECOND", F.col("probe_ts"), F.col("a1.ts"))
    earlier = F.col("b1").isNotNull() & (F.col("a1").isNull() | (gap_back <= gap_ahead))

    def choose(if_back: str, if_ahead: str, name: str) -> Column:
        return F.when(earlier, F.col(if_back)).otherwise(F.col(if_ahead)).alias(name)

    return around.select(
        "station", "probe_ts", choose("b1", "a1", "found"), choose("b2", "b1", "prev"), choose("a1", "a2", "next")
    )


def range_around(probes: DataFrame, readings: DataFrame, before: int = HOURS_BEFORE, after: int = HOURS_AFTER) -> DataFrame:
    """Highest and lowest reading in [probe - before, probe + after], exact at both ends.

    Whole hours come from hourly extremes (pre-aggregated), only the two edge hours of a probe
    look at readings. A probe meets a fixed number of hours, so the join grows with the probes.
    """
    hourly_key = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    hourly = (
        readings.groupBy("station", hourly_key.alias("hour")).agg(F.min("height").alias("low"), F.max("height").alias("high"))
    )
    start, end = F.col("probe_ts") - _hours(before), F.col("probe_ts") + _hours(after)
    first_hour = F.date_trunc("hour", start).cast("timestamp_ntz")
    last_hour = F.date_trunc("hour", end).cast("timestamp_ntz")
    spans = probes.select(
        "station",
        "probe_ts",
        start.alias("start"),
        end.alias("end"),
        F.explode(F.sequence(first_hour, last_hour, F.expr("interval 1 hour"))).alias("hour"),
    )
    is_edge = (F.col("hour") < F.col("start")) | (F.col("hour") + _hours(1) > F.col("end"))
    whole = spans.where(~is_edge).join(hourly, ["station", "hour"]).select("station", "probe_ts", "low", "high")
    raw = readings.select("station", hourly_key.alias("hour"), "ts", "height")
    edge = (
        spans.where(is_edge)
        .join(raw, ["station", "hour"])
        .where(F.col("ts").between(F.col("start"), F.col("end")))
        .select("station", "probe_ts", F.col("height").alias("low"), F.col("height").alias("high"))
    )
    return whole.unionByName(edge).groupBy("station", "probe_ts").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def tide_context(probes: DataFrame, readings: DataFrame) -> DataFrame:
    """Height now, stage and range for every probe."""
    near = nearest_reading(probes, readings, ["height"]).where("found is not null")
    staged = near.select(
        "station",
        "probe_ts",
        F.round("found.height", 2).alias("height_now"),
        stage(F.col("prev.height"), F.col("next.height"), F.col("found.height")).alias("stage"),
    )
    spread = range_around(probes, readings).select(
        "station", "probe_ts", F.round(F.col("high") - F.col("low"), 2).alias("daily_range")
    )
    return staged.join(spread, ["station", "probe_ts"])


def preferred_else_first(rows: DataFrame, group: str, key: str, position: str, preferred, default) -> DataFrame:
    """Per group: the preferred key when it occurs, else the first by position, else the default."""
    return rows.groupBy(group).agg(
        F.coalesce(
            F.max(F.when(F.col(key) == preferred, F.col(key))), F.min_by(key, position), F.lit(default)
        ).alias(key)
    )
