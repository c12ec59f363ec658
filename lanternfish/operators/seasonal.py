"""Seasonality: features, kernel scores, calendar affinity, zone profiles.

Everything starts from counts per (label, date). From there on the size depends on the calendar
and on the number of labels, never on the number of reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..schema import UNKNOWN_PLACE
from .grouping import ranked_list

# Kernel width in days, circular period, ratio smoothing, smallest training set.
SIGMA = 21.0
PERIOD = 366
RATIO_ALPHA = 2.0
MIN_TRAINING_ROWS = 10

# Weekday names, moon buckets; together with phases and flags all affinity keys.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
BUCKETS = ("dark", "balanced", "bright")
FLAGS = ("weekend", "holiday", "long_weekend")
AFFINITY_KEYS = (
    [f"weekday:{w}" for w in WEEKDAYS]
    + list(FLAGS)
    + [f"phase:{p}" for p in cal.PHASES]
    + [f"bucket:{b}" for b in BUCKETS]
)


def prepare_features(rows: DataFrame, date: str, label: str) -> DataFrame:
    """Drop undated and unlabelled rows, add calendar features and the yearly cycle."""
    kept = rows.where(F.col(date).isNotNull() & (F.col(label) != UNKNOWN_PLACE))
    return kept.select(
        *kept.columns, F.year(date).alias("actual_year"), *cal.calendar_columns(F.col(date))
    ).select(
        "*", cal.sin_day(F.col("day_of_year")).alias("sin_day"), cal.cos_day(F.col("day_of_year")).alias("cos_day")
    )


def label_dates(rows: DataFrame, label: str, date: str) -> DataFrame:
    """Reports per (label, year, date): the input of everything below."""
    return (
        rows.where(F.col(date).isNotNull() & F.col(label).isNotNull() & (F.col(label) != UNKNOWN_PLACE))
        .groupBy(F.col(label).alias("label"), F.col(date).alias("date"))
        .agg(F.count("*").alias("n"))
        .withColumn("year", F.year("date"))
    )


def seasonality_by_month(rows: DataFrame, date: str) -> DataFrame:
    """All 12 months with min(10, 5 x share of an average month); zeros without any rows."""
    counts = rows.where(F.col(date).isNotNull()).groupBy(F.month(date).alias("month")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    spine = rows.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    # least() skips nulls, so an empty month has to become 0 first
    score = F.least(F.coalesce(F.col("n") / (F.col("total") / 12) * 5, F.lit(0.0)), F.lit(10.0))
    return (
        spine.join(F.broadcast(counts), "month", "left")
        .join(F.broadcast(total), how="left")
        .select("month", F.round(score, 1).alias("score"))
    )


def kernel_weight(observed: Column, target: Column) -> Column:
    gap = F.abs(observed - target)
    distance = F.least(gap, PERIOD - gap).cast("double")
    return F.exp(-(distance * distance) / (2 * SIGMA * SIGMA))


def kernel_scores(counts: DataFrame, keys: list[str], day: str = "day_of_year") -> DataFrame:
    """Kernel score of every day 1..366 per key.

    Counts per (key, day of year) are handed to the 366 target days by a generator, inside one
    generated-code stage and with partial sums; no join, and at most 366 input rows per key.
    """
    daily = counts.groupBy(*keys, day).agg(F.sum("n").alias("n"))
    spread = daily.select(*keys, day, "n", F.explode(F.sequence(F.lit(1), F.lit(PERIOD))).alias("target_day"))
    weight = kernel_weight(F.col(day), F.col("target_day"))
    return spread.groupBy(*keys, "target_day").agg(F.sum(F.col("n") * weight).alias("score"))


def activity_index(counts: DataFrame) -> DataFrame:
    """Index of each day 1..366: 5 = average, capped at 10, one decimal; zeros without rows."""
    daily = counts.groupBy(F.dayofyear("date").alias("day_of_year")).agg(F.sum("n").alias("n"))
    scores = kernel_scores(daily, [])
    # 366 rows at most from here on
    mean = F.avg("score").over(W.partitionBy(F.lit(1)))
    spine = counts.sparkSession.range(1, PERIOD + 1).select(F.col("id").cast("int").alias("day"))
    index = F.round(F.least(F.col("score") / mean * 5, F.lit(10.0)), 1)
    indexed = scores.select(F.col("target_day").alias("day"), index.alias("activity"))
    return spine.join(indexed, "day", "left").select(
        "day", F.coalesce("activity", F.lit(0.0)).alias("activity")
    )


def seasonal_priors(counts: DataFrame) -> DataFrame:
    """Share of every label on every day, six decimals; nothing below ten training rows."""
    daily = counts.groupBy("label", F.dayofyear("date").alias("day_of_year")).agg(F.sum("n").alias("n"))
    enough = daily.agg(F.sum("n").alias("rows")).where(F.col("rows") >= MIN_TRAINING_ROWS)
    scores = kernel_scores(daily, ["label"]).where("score > 0")
    # one row per label and day: the window saves working out the scores twice
    total = F.sum("score").over(W.partitionBy("target_day"))
    shares = scores.select(F.col("target_day").alias("day"), "label", F.round(F.col("score") / total, 6).alias("prior"))
    return shares.join(F.broadcast(enough)).select("day", "label", "prior")


# ---------------------------------------------------------------- calendar affinity


def smoothed_ratio(matches: Column, total: Column, global_rate: Column) -> Column:
    ratio = F.round((matches + RATIO_ALPHA * global_rate) / (total + RATIO_ALPHA) / global_rate, 4)
    return F.when((total > 0) & (global_rate > 0), ratio).otherwise(F.lit(1.0))


def affinity_keys(date: Column) -> Column:
    """The affinity keys that apply to a date."""
    keys = F.array(
        F.concat(F.lit("weekday:"), cal.weekday_name(date)),
        F.when(cal.is_weekend(date), F.lit("weekend")),
        F.when(cal.is_holiday(date), F.lit("holiday")),
        F.when(cal.is_long_weekend(date), F.lit("long_weekend")),
        F.concat(F.lit("phase:"), cal.moon_phase(date)),
        F.concat(F.lit("bucket:"), cal.moon_bucket(cal.moon_illumination(date))),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def date_features(counts: DataFrame) -> DataFrame:
    """One row per date: features are evaluated once per date, however many labels it has."""
    return counts.select("date").distinct().withColumn("keys", affinity_keys(F.col("date")))


def key_counts(counts: DataFrame) -> DataFrame:
    """Reports per (year, label, key)."""
    keyed = counts.join(date_features(counts), "date").select("year", "label", "n", F.explode("keys").alias("key"))
    return keyed.groupBy("year", "label", "key").agg(F.sum("n").alias("n"))


def _ratios(spine: DataFrame, matches: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Ratio of every (by, label, key) of the spine. ``spine`` carries the rows of the label."""
    rates = matches.groupBy(*by, "key").agg(F.sum("n").alias("key_n"))
    if by:
        rates = rates.join(totals, by)
    else:
        rates = rates.join(F.broadcast(totals))
    rates = rates.select(*by, "key", (F.col("key_n") / F.col("total")).alias("rate"))
    joined = spine.join(matches, [*by, "label", "key"], "left").join(rates, [*by, "key"], "left")
    ratio = smoothed_ratio(F.coalesce("n", F.lit(0)), F.col("rows"), F.coalesce("rate", F.lit(0.0)))
    seen = (F.coalesce("rate", F.lit(0.0)) > 0) | F.col("key").isin(*FLAGS)
    return joined.where(seen).select(*by, "label", "key", ratio.alias("ratio"))


def _with_keys(labels: DataFrame) -> DataFrame:
    return labels.withColumn("key", F.explode(F.array(*[F.lit(k) for k in AFFINITY_KEYS])))


def calendar_affinity(counts: DataFrame) -> DataFrame:
    """(label, key, ratio): how much more often than average a label is reported on such days."""
    matches = key_counts(counts).groupBy("label", "key").agg(F.sum("n").alias("n"))
    labels = counts.groupBy("label").agg(F.sum("n").alias("rows"))
    totals = counts.agg(F.sum("n").alias("total"))
    return _ratios(_with_keys(labels), matches, totals, [])


def fold_affinity(counts: DataFrame, space: DataFrame) -> DataFrame:
    """The same per leave-one-year-out fold: training = everything minus the held-out year.

    ``space``: fold, label, rows (training rows of the label).
    """
    per_year = key_counts(counts)
    overall = per_year.groupBy("label", "key").agg(F.sum("n").alias("all_n"))
    held = per_year.select(F.col("year").alias("fold"), "label", "key", F.col("n").alias("held_n"))
    spine = _with_keys(space.select("fold", "label", "rows"))
    train = (
        spine.select("fold", "label", "key")
        .join(overall, ["label", "key"])
        .join(held, ["fold", "label", "key"], "left")
        .select("fold", "label", "key", (F.col("all_n") - F.coalesce("held_n", F.lit(0))).alias("n"))
    )
    totals = space.groupBy("fold").agg(F.sum("rows").alias("total"))
    return _ratios(spine, train, totals, ["fold"])


def ratio_map(affinity: DataFrame, by: list[str]) -> DataFrame:
    """Ratios as one map per label; the collected list is bounded by the fixed set of keys."""
    return affinity.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "ratio"))).alias("ratios"))


# ---------------------------------------------------------------- zone profiles


def zone_profiles(counts: DataFrame, definitions: DataFrame, supporting: DataFrame) -> DataFrame:
    """Everything known about a zone. ``counts``: label = zone. ``supporting``: zone, name, reports, member_rank."""
    dated = counts.groupBy("label").agg(F.sum("n").alias("dated_support_count"))
    years = (
        counts.select("label", "year")
        .distinct()
        .groupBy("label")
        .agg(F.sort_array(F.collect_set("year")).alias("actual_years"))
    )
    months = counts.groupBy("label", F.month("date").alias("month")).agg(F.sum("n").alias("n"))
    month_name = F.date_format(F.make_date(F.lit(2025), F.col("month"), F.lit(1)), "MMMM")
    best = ranked_list(months, ["label"], [F.col("n").desc(), F.col("month").asc()], month_name, 3, "best_months")
    spots = supporting.groupBy("zone").agg(
        F.sort_array(F.collect_list(F.struct("member_rank", "name", "reports"))).alias("supporting_spots")
    )
    ratios = ratio_map(calendar_affinity(counts), ["label"])
    facts = dated.join(years, "label").join(best, "label").join(ratios, "label").withColumnRenamed("label", "zone")
    joined = definitions.join(spots, "zone", "left").join(facts, "zone", "left")
    return joined.select(
        "zone",
        "lat",
        "lon",
        "tags",
        "spot_count",
        "support_count",
        F.coalesce("dated_support_count", F.lit(0)).alias("dated_support_count"),
        F.coalesce("actual_years", F.array().cast("array<int>")).alias("actual_years"),
        F.coalesce(F.col("supporting_spots")[0]["name"], F.col("zone")).alias("primary_spot"),
        "supporting_spots",
        F.coalesce("best_months", F.lit("")).alias("best_months"),
        "ratios",
    )
