"""Descriptive analytics over reports: counts, profiles, search, places and shortlists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import UNKNOWN_PLACE
from .grouping import ranked_list, top_per_group

# Page sizes of the reports.
SEARCH_LIMIT = 50
TOP_PLACES = 20
DIRECTORY_PAGE = 12
RECENT_ROWS = 18
IMAGE_PAGE = 12
CLUSTER_MEMBERS = 5

# Thresholds of the archive signal (reports, years).
STRONG_SIGNAL = (12, 5)
STEADY_SIGNAL = (4, 2)

DEFAULT_FINDER = "Unknown finder"


def parse_year_filter(raw: str | int | None) -> int | None:
    """"all", blank or anything that is no integer means: no filter."""
    if raw in (None, "", "all"):
        return None
    try:
        return int(raw)
    except (TypeError, ValueError):
        return None


def year_filter(rows: DataFrame, raw: str | int | None, column: str = "year") -> DataFrame:
    year = parse_year_filter(raw)
    return rows if year is None else rows.where(F.col(column) == year)


def present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def search(rows: DataFrame, needle: str, needle_label: str, fields: list[str], label: str, order: list[Column]) -> DataFrame:
    """Case-insensitive substring over the fields, or the same known label; newest 50.

    ``needle_label`` is the label the place rules give the search text. A '#' in the text asks for
    a number, so labels are not compared then.
    """
    lowered = needle.strip().lower()
    if not lowered:
        return rows.limit(0)
    hit = reduce(
        lambda a, b: a | b, [F.coalesce(F.lower(F.col(f).cast("string")).contains(lowered), F.lit(False)) for f in fields]
    )
    if "#" not in needle and needle_label != UNKNOWN_PLACE:
        hit = hit | F.coalesce(F.col(label) == needle_label, F.lit(False))
    return rows.where(hit).orderBy(*order).limit(SEARCH_LIMIT)


def group_hits(hits: DataFrame, label: str, finder: str, id_column: str, order: list[Column]) -> DataFrame:
    """Hits grouped by label in first-seen order: latest report, first three finders, count.

    Input is one result page (at most 50 rows), so the window without a partition and the
    collected lists are bounded. Unlabelled hits stay ungrouped, each as a group of its own.
    """
    shown = F.coalesce(F.nullif(F.col(finder), F.lit("")), F.lit(DEFAULT_FINDER))
    known = F.col(label).isNotNull() & (F.col(label) != "") & (F.col(label) != UNKNOWN_PLACE)
    ranked = hits.withColumn("_rank", F.row_number().over(W.orderBy(*order))).select(
        F.when(known, F.col(label)).otherwise(F.lit(UNKNOWN_PLACE)).alias("label"),
        F.when(known, F.lit(None)).otherwise(F.col(id_column)).alias("_single"),
        "_rank",
        F.col(id_column).alias("_id"),
        shown.alias("_finder"),
    )
    items = F.sort_array(F.collect_list(F.struct("_rank", "_id", "_finder")))
    grouped = ranked.groupBy("label", "_single").agg(
        F.min("_rank").alias("first_rank"), F.count("*").alias("reports"), items.alias("_items")
    )
    return grouped.select(
        "label",
        "first_rank",
        "reports",
        F.col("_items")[0]["_id"].alias("latest_id"),
        F.concat_ws(
            ",", F.slice(F.array_distinct(F.transform("_items", lambda s: s["_finder"])), 1, 3)
        ).alias("recent_finders"),
        F.concat_ws(",", F.transform("_items", lambda s: s["_id"].cast("string"))).alias("report_ids"),
    )


def label_counts(rows: DataFrame, label: str, keep_unknown: bool = True) -> DataFrame:
    kept = rows if keep_unknown else rows.where(F.col(label) != UNKNOWN_PLACE)
    return kept.groupBy(label).agg(F.count("*").alias("reports"))


def mapped_spots(counts: DataFrame, places: DataFrame, label: str) -> DataFrame:
    """Counts with coordinates; labels without any are dropped. Counted first, joined afterwards."""
    return counts.join(places.select(F.col("name").alias(label), "lat", "lon"), label)


def map_clusters(spots: DataFrame) -> DataFrame:
    """Spots sharing coordinates: total, ranked top five, rest, label. ``spots``: name, reports, lat, lon."""
    order = [F.col("reports").desc(), F.col("name").asc()]
    totals = spots.groupBy("lat", "lon").agg(
        F.sum("reports").cast("bigint").alias("reports"), F.count("*").alias("spot_count")
    )
    members = ranked_list(
        spots, ["lat", "lon"], order, F.concat_ws(":", F.col("name"), F.col("reports").cast("string")), CLUSTER_MEMBERS, "members"
    )
    lead = top_per_group(spots, ["lat", "lon"], order, 1).select("lat", "lon", F.col("name").alias("_lead"))
    return totals.join(members, ["lat", "lon"]).join(lead, ["lat", "lon"]).select(
        "lat",
        "lon",
        "reports",
        "spot_count",
        F.when(F.col("spot_count") == 1, F.col("_lead")).otherwise(F.concat("_lead", F.lit(" area"))).alias("label"),
        "members",
        F.greatest(F.col("spot_count") - CLUSTER_MEMBERS, F.lit(0)).alias("remaining_spots"),
    )


def heat_weights(clusters: DataFrame) -> DataFrame:
    """max(sqrt(count / largest count), .18); the largest count is a one-row aggregate, not a window."""
    largest = clusters.agg(F.max("reports").alias("_max"))
    weight = F.greatest(F.sqrt(F.col("reports") / F.col("_max")), F.lit(0.18))
    return clusters.join(F.broadcast(largest)).select("label", "reports", weight.alias("weight"))


def archive_signal(reports: Column, years: Column) -> Column:
    return (
        F.when((reports >= STRONG_SIGNAL[0]) | (years >= STRONG_SIGNAL[1]), "strong archive signal")
        .when((reports >= STEADY_SIGNAL[0]) | (years >= STEADY_SIGNAL[1]), "steady archive signal")
        .otherwise("light archive signal")
    )


def place_summary(rows: DataFrame, place: str, finder: str, date: str, id_column: str) -> DataFrame:
    """Detail figures of all places at once: size, years, peak year, top finder, latest dated report.

    Every part is pre-aggregated, so a place that holds a third of all rows costs no more than
    its distinct years and finders.
    """
    years = rows.groupBy(place, "year").agg(F.count("*").alias("n"))
    per_year = years.groupBy(place).agg(
        F.sum("n").cast("bigint").alias("reports"),
        F.count("*").alias("years_tracked"),
        F.max_by("year", F.struct("n", "year")).alias("peak_year"),
        F.max("n").alias("peak_reports"),
    )
    # first seen = newest by (year, date, id); blank dates sort last
    newest = F.struct("year", F.coalesce(F.col(date).cast("string"), F.lit("")), id_column)
    finders = (
        rows.where(present(finder)).groupBy(place, finder).agg(F.count("*").alias("n"), F.max(newest).alias("seen"))
    )
    top_finder = finders.groupBy(place).agg(
        F.max_by(finder, F.struct("n", "seen")).alias("top_finder"), F.max("n").alias("top_finder_reports")
    )
    latest = rows.where(F.col(date).isNotNull()).groupBy(place).agg(F.max_by(id_column, newest).alias("latest_id"))
    return per_year.join(top_finder, place, "left").join(latest, place, "left")


def split_recent(rows: DataFrame, keys: list[str], order: list[Column], id_column: str, k: int, name: str) -> DataFrame:
    """All rows, marked whether they belong to the first k of their group.

    The first k per group are found with a pre-shuffle group limit and matched back by id, so
    no task ever sorts a whole hot group.
    """
    first = top_per_group(rows, keys, order, k, "_r").select(id_column, F.lit(True).alias(name))
    return rows.join(first, id_column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def directory_page(counts: DataFrame, order: list[Column], size: int = DIRECTORY_PAGE) -> DataFrame:
    """First page of a directory with the number of entries left."""
    total = counts.agg(F.count("*").alias("total"))
    page = counts.orderBy(*order).limit(size)
    remaining = F.greatest(F.col("total") - size, F.lit(0))
    return page.join(F.broadcast(total)).select(
        *counts.columns, remaining.alias("remaining"), (remaining > 0).alias("has_more")
    )


def shortlist(spots: DataFrame, zones: DataFrame, members: DataFrame) -> DataFrame:
    """One best bet, up to four worthwhile stops, up to six more options; no spot twice.

    ``spots``: name, reports. ``zones``: zone, zone_rank (the few ranked zones of one briefing).
    ``members``: zone, name, member_rank (at most five per zone, the first is the primary spot).
    Zone members come first, in zone and member order, then the archive by count. Members that do
    not fit into the four are still kept out of the further options.
    """
    archive_order = [F.col("reports").desc(), F.col("name").asc()]
    # at most 1 + 4 + 6 archive spots can be shown besides the zone members to be skipped
    zone_members = (
        members.join(zones, "zone")
        .groupBy("name")
        .agg(F.min(F.struct("zone_rank", "member_rank")).alias("at"))
        .select("name", "at")
    )
    known = zone_members.join(spots, "name").select("name", "reports", "at")
    archive = (
        spots.join(zone_members.select("name"), "name", "left_anti").orderBy(*archive_order).limit(11)
        .withColumn("at", F.lit(None).cast(known.schema["at"].dataType))
    )
    # from here on: a handful of rows
    listed = known.unionByName(archive)
    one = W.partitionBy(F.lit(1))
    lead = (F.col("at.zone_rank") == 1) & (F.col("at.member_rank") == 1)
    leader = F.row_number().over(one.orderBy(*archive_order)) == 1
    marked = listed.select(
        "*", F.coalesce(lead, F.lit(False)).alias("is_lead"), leader.alias("is_leader")
    ).withColumn("has_lead", F.max("is_lead").over(one))
    # without a known lead zone the archive leader is the best bet
    best = F.when(F.col("has_lead"), F.col("is_lead")).otherwise(F.col("is_leader"))
    marked = marked.select("name", "reports", "at", best.alias("best"))
    ranked = marked.select(
        "*",
        F.row_number().over(one.orderBy(F.col("best").desc(), F.col("at").asc_nulls_last(), *archive_order)).alias("pos"),
        F.count(F.when(F.col("at").isNotNull() & ~F.col("best"), 1)).over(one).alias("zone_spots"),
    )
    after = F.col("pos") - 1 - F.greatest(F.col("zone_spots"), F.lit(4))
    tier = (
        F.when(F.col("best"), "1 best bet")
        .when(F.col("pos") <= 5, "2 worthwhile")
        .when(F.col("at").isNull() & after.between(1, 6), "3 more options")
    )
    return ranked.select("name", "reports", tier.alias("tier"), F.col("pos").alias("position")).where("tier is not null")
