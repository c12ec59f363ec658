"""Zones: dictionary places sharing coordinates, led by their most reported member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ZONE_TAGS, any_keyword, tag_list
from .grouping import ranked_list, top_per_group

TOP_MEMBERS = 5


def zone_members(counts: DataFrame, places: DataFrame, label: str) -> DataFrame:
    """Every dictionary place (also unreported ones) with its zone: name, reports, lat, lon, zone."""
    spots = places.select("name", "lat", "lon").join(counts.withColumnRenamed(label, "name"), "name", "left").select(
        "name", "lat", "lon", F.coalesce("reports", F.lit(0)).alias("reports")
    )
    sizes = spots.groupBy("lat", "lon").agg(F.count("*").alias("_size"))
    lead = top_per_group(spots, ["lat", "lon"], [F.col("reports").desc(), F.col("name").asc()], 1).select(
        "lat", "lon", F.col("name").alias("_lead")
    )
    zone = F.when(F.col("_size") == 1, F.col("_lead")).otherwise(F.concat("_lead", F.lit(" area")))
    labels = sizes.join(lead, ["lat", "lon"]).select("lat", "lon", zone.alias("zone"))
    return spots.join(labels, ["lat", "lon"])


def top_members(members: DataFrame, k: int = TOP_MEMBERS) -> DataFrame:
    """zone, name, reports, member_rank of the first k members."""
    ranked = top_per_group(members, ["zone"], [F.col("reports").desc(), F.col("name").asc()], k, "member_rank")
    return ranked.select("zone", "name", "reports", "member_rank")


def zone_definitions(members: DataFrame) -> DataFrame:
    """One row per zone: support, number of spots, first spots, tags.

    A tag applies when any member name holds one of its keywords, so member names are never
    collected: the flags are aggregated.
    """
    flags = [F.bool_or(any_keyword(F.col("name"), words)).alias(tag) for tag, words in ZONE_TAGS.items()]
    totals = members.groupBy("zone", "lat", "lon").agg(
        F.sum("reports").cast("bigint").alias("support_count"), F.count("*").alias("spot_count"), *flags
    )
    first = ranked_list(
        members, ["zone"], [F.col("reports").desc(), F.col("name").asc()], F.col("name"), TOP_MEMBERS, "spots"
    )
    return totals.join(first, "zone").select(
        "zone",
        "lat",
        "lon",
        "support_count",
        "spot_count",
        "spots",
        tag_list({tag: F.col(tag) for tag in ZONE_TAGS}).alias("tags"),
    )


def label_to_zone(rows: DataFrame, members: DataFrame, label: str) -> DataFrame:
    """Rows with the zone of their label; labels outside the dictionary are dropped."""
    return rows.join(members.select(F.col("name").alias(label), "zone"), label)
