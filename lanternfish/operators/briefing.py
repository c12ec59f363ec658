"""Daily ranked briefing for a whole table of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import backtest, seasonal
from .grouping import top_per_group

# Multiplier bounds and steps, label thresholds, freshness.
BOUNDS = (0.85, 1.25)
REASON_RATIO = 1.08
RECENCY_STEP, RECENCY_CAP = 0.08, 0.24
RISING_BONUS, RANGE_BONUS, RANGE_MALUS, WIDE_RANGE = 0.08, 0.04, 0.03, 2.5
SEVERE_MALUS, CALM_BONUS, SHELTER_BONUS = 0.12, 0.05, 0.04
CALM_WIND, STRONG_WIND, DRY_CHANCE = 12, 18, 50
ACTIVE, STEADY = 7.5, 4.5
BEST, USEFUL = 0.85, 0.6
LEAD_STEP = 0.7
STALE_HOURS = 48
# Model whose scores take the live context into account.
HYBRID = "hybrid_zone"

TOP_ZONES = 3

# Texts of the briefing.
REASON_WEEKEND = "Usually stronger on weekends."
REASON_HOLIDAY = "Holiday timing has helped here before."
REASON_LONG_WEEKEND = "Long weekends have historically helped this zone."
REASON_RECENT = "Recent reports support this zone."
REASON_TIDE = "Favorable incoming tide for waterfront spots."
REASON_SEVERE = "Weather is a drag today."
REASON_CALM = "Current weather is workable for exposed shoreline spots."
REASON_SHELTER = "Stronger wind can make sheltered trail zones comparatively better."


def bounded(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))


def calendar_multiplier(ratios: Column, keys: Column) -> Column:
    return bounded(backtest.multiplier(ratios, keys))


def calendar_reason(ratios: Column, keys: Column) -> Column:
    """The last applicable reason wins: holiday (or long weekend) over weekend."""

    def strong(key: str) -> Column:
        ratio = F.coalesce(F.try_element_at(ratios, F.lit(key)), F.lit(1.0))
        return F.array_contains(keys, key) & (ratio >= REASON_RATIO)

    holiday = F.array_contains(keys, "holiday")
    return (
        F.when(strong("holiday"), REASON_HOLIDAY)
        .when(~holiday & strong("long_weekend"), REASON_LONG_WEEKEND)
        .when(strong("weekend"), REASON_WEEKEND)
    )


def recency_multiplier(zone_recent: Column, all_recent: Column) -> Column:
    boost = 1.0 + F.least(zone_recent * RECENCY_STEP, F.lit(RECENCY_CAP))
    return F.when((zone_recent > 0) & (all_recent > 0), bounded(boost)).otherwise(F.lit(1.0))


def recency_reason(zone_recent: Column, all_recent: Column) -> Column:
    return F.when((zone_recent > 0) & (all_recent > 0), REASON_RECENT)


def has_tag(tags: Column, tag: str) -> Column:
    return F.array_contains(tags, tag)


def tide_multiplier(tags: Column, stage: Column, daily_range: Column) -> Column:
    """1.0 when nothing is known about the tide."""
    wide = F.coalesce(daily_range, F.lit(0.0)) >= WIDE_RANGE
    water = (
        1.0
        + F.when(stage == "rising", RISING_BONUS).otherwise(F.lit(0.0))
        + F.when(wide, RANGE_BONUS).otherwise(F.lit(0.0))
    )
    change = F.when(has_tag(tags, "waterfront"), water).when(has_tag(tags, "trail") & wide, F.lit(1.0 - RANGE_MALUS))
    return F.when(stage.isNull(), F.lit(1.0)).otherwise(bounded(F.coalesce(change, F.lit(1.0))))


def tide_reason(tags: Column, stage: Column) -> Column:
    return F.when(has_tag(tags, "waterfront") & (stage == "rising"), REASON_TIDE)


def _weather_cases(tags: Column, wind: Column, chance: Column, severe: Column) -> list[Column]:
    calm = has_tag(tags, "waterfront") & (F.coalesce(wind, F.lit(0)) <= CALM_WIND) & (F.coalesce(chance, F.lit(0)) < DRY_CHANCE)
    shelter = has_tag(tags, "trail") & (F.coalesce(wind, F.lit(0)) >= STRONG_WIND)
    return [F.coalesce(severe, F.lit(False)), calm, shelter]


def weather_multiplier(tags: Column, wind: Column, chance: Column, severe: Column) -> Column:
    """1.0 when nothing is known about the weather (``severe`` is null)."""
    bad, calm, shelter = _weather_cases(tags, wind, chance, severe)
    change = F.when(bad, 1.0 - SEVERE_MALUS).when(calm, 1.0 + CALM_BONUS).when(shelter, 1.0 + SHELTER_BONUS)
    return F.when(severe.isNull(), F.lit(1.0)).otherwise(bounded(change.otherwise(F.lit(1.0))))


def weather_reason(tags: Column, wind: Column, chance: Column, severe: Column) -> Column:
    bad, calm, shelter = _weather_cases(tags, wind, chance, severe)
    text = F.when(bad, REASON_SEVERE).when(calm, REASON_CALM).when(shelter, REASON_SHELTER)
    return F.when(severe.isNotNull(), text)


def activity_label(score: Column) -> Column:
    return F.when(score >= ACTIVE, "Active").when(score >= STEADY, "Steady").otherwise("Quiet")


def signal_label(score: Column, best: Column) -> Column:
    share = score / best
    return (
        F.when(best <= 0, "Low signal")
        .when(share >= BEST, "Best signal")
        .when(share >= USEFUL, "Useful fallback")
        .otherwise("Thin support")
    )


def reason_tags(reasons: Column, best_months: Column, date: Column) -> Column:
    """At most three short tags: a strong month first, then one per reason."""
    month = F.date_format(date, "MMMM")
    strong = F.array_contains(F.slice(F.split(best_months, ","), 1, 2), month)
    head = F.when(strong, F.concat(F.lit("Strong "), F.lower(month), F.lit(" history")))
    short = F.transform(
        reasons,
        lambda r: F.when(r == REASON_RECENT, "Recent finds nearby")
        .when(r == REASON_TIDE, "Favorable incoming tide")
        .when(r == REASON_SEVERE, "Weather is a drag today")
        .when(r.isin(REASON_WEEKEND, REASON_HOLIDAY, REASON_LONG_WEEKEND), "Calendar timing fits past hits")
        .when(r == REASON_CALM, "Weather favors shoreline scouting"),
    )
    tags = F.slice(F.filter(F.concat(F.array(head), short), lambda t: t.isNotNull()), 1, 3)
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("Strong base seasonal signal")))


def confidence_band(top3: Column, support: Column, years: Column, live_features: Column) -> Column:
    return (
        F.when((top3 >= 0.2) & (support >= 18) & (years >= 3) & (live_features >= 2), "high")
        .when((top3 >= 0.1) & (support >= 8) & (years >= 2), "medium")
        .otherwise("low")
    )


def scored_zones(
    dates: DataFrame,
    priors: DataFrame,
    profiles: DataFrame,
    zone_recency: DataFrame,
    recency: DataFrame,
    tide: DataFrame,
    weather: DataFrame,
) -> DataFrame:
    """Every zone with a prior on every date, with its multipliers.

    ``dates``: date. ``zone_recency``: date, zone, zone_recent. ``recency``: date, all_recent.
    ``tide``: date, stage, daily_range. ``weather``: date, wind, precip_chance, severe. The result
    has one row per date and zone, whatever the number of reports.
    """
    featured = dates.select("date", F.dayofyear("date").alias("day"), seasonal.affinity_keys(F.col("date")).alias("keys"))
    context = (
        featured.join(recency, "date", "left").join(tide, "date", "left").join(weather, "date", "left")
    )
    joined = (
        context.join(priors.where("prior > 0").withColumnRenamed("label", "zone"), "day")
        .join(profiles, "zone")
        .join(zone_recency, ["date", "zone"], "left")
    )
    near, total = F.coalesce("zone_recent", F.lit(0)), F.coalesce("all_recent", F.lit(0))
    tags = F.col("tags")
    stage, wide = F.col("stage"), F.col("daily_range")
    air = (F.col("wind"), F.col("precip_chance"), F.col("severe"))
    return joined.select(
        "date",
        "day",
        "zone",
        "prior",
        "support_count",
        "dated_support_count",
        F.size("actual_years").alias("years"),
        "best_months",
        "primary_spot",
        "tags",
        calendar_multiplier(F.col("ratios"), F.col("keys")).alias("calendar_mult"),
        recency_multiplier(near, total).alias("recency_mult"),
        tide_multiplier(tags, stage, wide).alias("tide_mult"),
        weather_multiplier(tags, *air).alias("weather_mult"),
        F.filter(
            F.array(
                calendar_reason(F.col("ratios"), F.col("keys")),
                recency_reason(near, total),
                tide_reason(tags, stage),
                weather_reason(tags, *air),
            ),
            lambda r: r.isNotNull(),
        ).alias("reasons"),
        (stage.isNotNull().cast("int") + F.col("severe").isNotNull().cast("int")).alias("live_features"),
    )


def lead_changes(priors: DataFrame, activity: DataFrame, leads: DataFrame) -> DataFrame:
    """Per date: did the lead zone rotate, or did the activity change, against the day before?

    ``leads``: date, zone (today's lead). Yesterday's lead is the strongest prior of its day.
    """
    strongest = top_per_group(
        priors, ["day"], [F.col("prior").desc(), F.col("label").asc()], 1, "_r"
    ).select("day", F.col("label").alias("lead_before"))
    yesterday = F.date_sub("date", 1)
    dated = leads.select("date", "zone", F.dayofyear("date").alias("day"), F.dayofyear(yesterday).alias("day_before"))
    joined = (
        dated.join(strongest.withColumnRenamed("day", "day_before"), "day_before", "left")
        .join(activity.select(F.col("day").alias("day"), F.col("activity").alias("now")), "day", "left")
        .join(activity.select(F.col("day").alias("day_before"), F.col("activity").alias("before")), "day_before", "left")
    )
    # index values have one decimal; rounding keeps 0.7 from becoming 0.69999
    change = F.round(F.coalesce("now", F.lit(0.0)) - F.coalesce("before", "now", F.lit(0.0)), 6)
    text = (
        F.when(
            F.col("zone") != F.col("lead_before"),
            F.concat(F.lit("Lead zone rotated from "), F.col("lead_before"), F.lit(" to "), F.col("zone"), F.lit(".")),
        )
        .when(change >= LEAD_STEP, "Island-wide activity strengthened from yesterday.")
        .when(change <= -LEAD_STEP, "Island-wide activity softened from yesterday.")
        .otherwise("The daily read is steady versus yesterday.")
    )
    return joined.select("date", text.alias("lead_change"))


def daily_briefing(scored: DataFrame, priors: DataFrame, activity: DataFrame, selection: DataFrame) -> DataFrame:
    """Top three zones per date with score, labels, tags, confidence and lead change.

    ``selection``: one row (primary_model, top3_accuracy) of the backtest. Which scores count is decided inside the plan.
    """
    base = F.col("prior")
    full = base * F.col("calendar_mult") * F.col("recency_mult") * F.col("tide_mult") * F.col("weather_mult")
    scores = scored.join(F.broadcast(selection)).withColumn("score", F.when(F.col("primary_model") == HYBRID, full).otherwise(base))
    top = top_per_group(scores, ["date"], [F.col("score").desc(), F.col("zone").asc()], TOP_ZONES)
    # three rows per date from here on
    per_date = W.partitionBy("date")
    lead = F.max(F.when(F.col("rank") == 1, F.struct("dated_support_count", "years", "live_features"))).over(per_date)
    labelled = top.select(
        "*",
        signal_label(F.col("score"), F.max("score").over(per_date)).alias("signal"),
        lead.alias("_lead"),
    )
    leads = labelled.where("rank = 1").select("date", "zone")
    joined = labelled.join(lead_changes(priors, activity, leads), "date").join(
        activity.select("day", "activity"), "day", "left"
    )
    index = F.coalesce("activity", F.lit(0.0))
    return joined.select(
        "date",
        "rank",
        "zone",
        F.col("score"),
        "primary_spot",
        "signal",
        reason_tags(F.col("reasons"), F.col("best_months"), F.col("date")).alias("reason_tags"),
        index.alias("activity_score"),
        activity_label(index).alias("activity_label"),
        confidence_band(
            F.col("top3_accuracy"), F.col("_lead.dated_support_count"), F.col("_lead.years"), F.col("_lead.live_features")
        ).alias("confidence_band"),
        "lead_change",
        F.col("primary_model").alias("selected_model"),
    )


def freshness(generated: Column, now: Column) -> list[Column]:
    """Age label ("5 hours", "2 days", "3 weeks") and whether the artifact is stale."""
    seconds = F.greatest(F.timestamp_diff("SECOND", generated, now), F.lit(0))
    hours, days = F.floor(seconds / 3600), F.floor(seconds / 86400)
    number = F.when(hours < 24, F.greatest(hours, F.lit(1))).when(days < 7, days).otherwise(F.floor(days / 7))
    unit = F.when(hours < 24, "hour").when(days < 7, "day").otherwise("week")
    plural = F.when(number == 1, F.lit("")).otherwise(F.lit("s"))
    return [
        F.concat(number.cast("string"), F.lit(" "), unit, plural).alias("age"),
        (seconds >= STALE_HOURS * 3600).alias("is_stale"),
    ]
