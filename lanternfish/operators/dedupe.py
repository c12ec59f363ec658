"""Duplicate reports merged to one best record, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose_title, is_placeholder, split_number_title
from ..schema import RECORD_FIELDS, UNKNOWN_PLACE

# Finder texts that mean "unknown".
UNKNOWN_FINDER = "not specified"


def keyed(records: DataFrame, label: Column) -> DataFrame:
    """Records with parsed number and finder and their group key.

    Without a year, number or known place a record is its own group: its key holds the id, so
    such rows spread over all tasks instead of sharing one null key.
    """
    parsed = records.select(*RECORD_FIELDS, split_number_title(F.col("title")).alias("_t"), label.alias("place"))
    groupable = (
        (F.trim("year") != "") & (F.col("_t.number") != "") & (F.col("place") != "") & (F.col("place") != UNKNOWN_PLACE)
    )
    own = F.when(F.coalesce(groupable, F.lit(False)), F.lit("")).otherwise(F.col("id"))
    return parsed.select(
        *RECORD_FIELDS, F.col("_t.number").alias("number"), F.col("_t.finder").alias("finder"), "place", own.alias("own")
    )


def _known(finder: Column) -> Column:
    return F.when((finder != "") & (F.lower(finder) != UNKNOWN_FINDER), finder)


def best_score() -> Column:
    image = F.when(F.col("image") == "", 0).when(is_placeholder(F.col("image")), 1).otherwise(2)
    return F.struct(
        (F.col("date_found") != "").cast("int").alias("dated"),
        image.alias("image"),
        _known(F.col("finder")).isNotNull().cast("int").alias("named"),
        F.length("location").alias("detail"),
        F.coalesce(F.col("id").try_cast("bigint"), F.lit(0)).alias("id"),
    )


def dedupe_best_record(records: DataFrame, label: Column) -> DataFrame:
    """Best record of every group and the group size; partial aggregation keeps copies off the wire."""
    rows = keyed(records, label)
    best = rows.groupBy("year", "number", "place", "own").agg(
        F.max_by("id", best_score()).alias("kept_id"), F.count("*").alias("copies")
    )
    return best.select("year", "number", "place", "kept_id", "copies")


def merge_duplicates(records: DataFrame, label: Column) -> DataFrame:
    """One record per group with field-level survivorship: longest finder, place and image, last date."""
    rows = keyed(records, label)

    def longest(value: Column) -> Column:
        text = F.when(value != "", value)
        return F.max(F.when(text.isNotNull(), F.struct(F.length(text).alias("n"), text.alias("v"))))

    placeholder = is_placeholder(F.col("image"))
    whole = F.struct(*RECORD_FIELDS, "finder")
    merged = rows.groupBy("year", "number", "place", "own").agg(
        F.max_by(whole, best_score()).alias("best"),
        longest(_known(F.col("finder"))).alias("finder"),
        longest(F.trim("location")).alias("location"),
        longest(F.when(~placeholder, F.trim("image"))).alias("image"),
        longest(F.trim("image")).alias("any_image"),
        F.max(F.nullif(F.trim("date_found"), F.lit(""))).alias("date_found"),
        F.count("*").alias("copies"),
    )
    many = F.col("copies") > 1
    title = compose_title(F.col("number"), F.coalesce("finder.v", "best.finder"), F.col("best.title"))
    image = F.coalesce("image.v", F.nullif("best.image", F.lit("")), "any_image.v", F.lit(""))

    def pick(name: str, value: Column) -> Column:
        return F.when(many, value).otherwise(F.col(f"best.{name}")).alias(name)

    return merged.select(
        F.col("best.id").alias("id"),
        "year",
        pick("title", title),
        F.col("best.url").alias("url"),
        pick("image", image),
        pick("location", F.coalesce("location.v", "best.location")),
        pick("date_found", F.coalesce("date_found", F.lit(""))),
        "number",
        "place",
        "copies",
    )


def merge_report(records: DataFrame, label: Column) -> DataFrame:
    """(kept_id, merged_id) pairs of all groups with copies, one row per member."""
    rows = keyed(records, label).where("own = ''").select("year", "number", "place", F.col("id").alias("merged_id"))
    best = dedupe_best_record(records, label).where("copies > 1")
    return rows.join(best, ["year", "number", "place"]).select("year", "number", "place", "kept_id", "merged_id")
