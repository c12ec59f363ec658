"""Validation queries over reports with planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import grouping, quality
from . import views
from .registry import query, table

PLACE_RULES = (("nation_1", "First Shore"), ("nation_2", "Second Shore"), ("nation_5", "Fifth Shore"))
FIRST_SEASON, LAST_SEASON = 1996, 2001


def raw_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as raw text with defects: odd years and numbers, broken dates and images, copies."""
    f = views.finds(spark, folder)
    key = F.col("id")
    date = F.date_format("date_found", "MMMM d, yyyy")
    return f.select(
        key.cast("string").alias("id"),
        F.when(key % 50 == 0, "unknown").otherwise(F.concat(F.lit("Season "), F.col("year").cast("string"))).alias("_y"),
        F.when(key % 40 == 1, "").when(key % 40 == 2, "n/a").otherwise(F.concat(F.lit("# "), F.col("number"))).alias(
            "float_number"
        ),
        F.when(key % 80 == 1, "#421 Bob").otherwise(F.col("finder")).alias("finder"),
        F.col("place").alias("location_raw"),
        F.lit("").alias("location_normalized"),
        F.when(F.col("status") == "F", "").when(key % 45 == 3, "13/45/2025").otherwise(date).alias("date_found"),
        F.concat(F.lit("https://www.Archive.example.org/finds/"), F.col("custkey")).alias("url"),
        F.when(key % 60 == 5, "not-a-url").otherwise("https://img.example.org/a.jpg").alias("image_url"),
        F.col("year").cast("string").alias("_year"),
    ).select("*", F.when(F.col("_y") == "unknown", F.col("_y")).otherwise(F.col("_year")).alias("year")).drop("_y", "_year")


RAW = views.FINDS + """,
raw as (
  select cast(id as varchar) as id, id as k, case when id % 50 = 0 then null else year end as year,
         case when id % 40 = 1 then '' when id % 40 = 2 then 'n/a' else cast(number as varchar) end as float_number,
         case when id % 40 in (1, 2) then null else number end as number_value,
         case when id % 80 = 1 then '#421 Bob' else finder end as finder, place as location_raw,
         case when contains(lower(place), 'nation_1') then 'First Shore' when contains(lower(place), 'nation_2') then 'Second Shore'
              when contains(lower(place), 'nation_5') then 'Fifth Shore' else 'Other/Unknown' end as location_normalized,
         case when status = 'F' then '' when id % 45 = 3 then '13/45/2025' else cast(date_found as varchar) end as date_found,
         status <> 'F' and id % 45 = 3 as malformed,
         'https://www.Archive.example.org/finds/' || custkey as url,
         case when id % 60 = 5 then 'not-a-url' else 'https://img.example.org/a.jpg' end as image_url
  from finds)"""

CHECKED = RAW + f""",
dn as (select distinct year, number_value as number from raw where number_value is not null and year is not null),
rk as (select *, row_number() over w as rn, lag(number, 3) over w as ref from dn window w as (partition by year order by number)),
fl as (select *, coalesce(rn >= 6 and number >= 1.5 * ref and number - ref >= 500, false) as extreme from rk),
outl as (select year, number from (select *, max(case when not extreme then rn end) over (partition by year) as lc from fl) where rn > lc),
counted as (
  select r.*, count(*) over (partition by r.year, float_number, finder, location_raw, date_found, url, image_url) as copies,
         case when r.year is null or float_number = '' then 0
              else count(*) over (partition by r.year, float_number, location_normalized) end as same_key,
         s_suppkey is not null and s_suppkey % 2 = 0 as waived, o.number is not null as is_outlier
  from raw r left join supplier on s_suppkey = r.k left join outl o on o.year = r.year and o.number = r.number_value),
checked as (
  select *, list_filter([
      case when year is null or year < {FIRST_SEASON} or year > {LAST_SEASON} then 'invalid_year' end,
      case when malformed then 'invalid_date' end,
      case when not waived and (float_number in ('', 'n/a') or length(float_number) > 5) then 'invalid_float_number' end,
      case when image_url = 'not-a-url' then 'invalid_image_url' end,
      case when is_outlier then 'extreme_float_number_outlier' end], lambda x: x is not null) as errors,
    list_filter([
      case when malformed then 'malformed_date_string' end,
      case when float_number = '' and finder like '#%' then 'blank_float_with_hash_finder' end,
      case when copies > 1 then 'duplicate_exact_row' end,
      case when same_key > 1 then 'duplicate_float_year_location' end], lambda x: x is not null) as flags
  from counted)"""


def waivers(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    listed = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("invalid_float_number"))).otherwise(
        F.array().cast("array<string>")
    )
    return s.select(F.col("s_suppkey").cast("string").alias("id"), listed.alias("waivers"))


def checked(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validate(
        raw_reports(spark, folder),
        PLACE_RULES,
        waivers(spark, folder),
        default_source="archive",
        first_season=FIRST_SEASON,
        last_season=LAST_SEASON,
    )


def joined(c: str):
    return F.concat_ws(",", c)


@query("row_errors", f"with {CHECKED} select id, array_to_string(errors, ',') as errors from checked")
def row_errors(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).select("id", joined("errors").alias("errors"))


@query("row_suspicions", f"with {CHECKED} select id, array_to_string(flags, ',') as flags from checked")
def row_suspicions(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).select("id", joined("suspicious_flags").alias("flags"))


@query(
    "confidence",
    f"""with {CHECKED} select len(errors) = 0 as is_valid,
        round(greatest(0.0, 1 - 0.25 * len(errors) - 0.10 * len(flags))::double, 2) as confidence_score, count(*) as rows
        from checked group by 1, 2""",
)
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).groupBy("is_valid", "confidence_score").agg(F.count("*").alias("rows"))


@query(
    "validation_run",
    f"""with {CHECKED} select id, coalesce(cast(year as varchar), '') as year, float_number, finder, location_normalized, date_found,
        'archive.example.org' as source, array_to_string(errors, ',') as errors, array_to_string(flags, ',') as suspicious_flags,
        len(errors) = 0 as is_valid, round(greatest(0.0, 1 - 0.25 * len(errors) - 0.10 * len(flags))::double, 2) as confidence_score
        from checked""",
)
def validation_run(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).select(
        "id",
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        "float_number",
        "finder",
        "location_normalized",
        "date_found",
        "source",
        joined("errors").alias("errors"),
        joined("suspicious_flags").alias("suspicious_flags"),
        "is_valid",
        "confidence_score",
    )


@query(
    "validation_summary",
    f"""with {CHECKED}, c as (
          select unnest(list_concat(['total_rows', case when len(errors) = 0 then 'valid_rows' else 'invalid_rows' end,
              case when len(flags) > 0 then 'suspicious_rows' end, case when len(errors) + len(flags) > 0 then 'flagged_rows' end],
              list_transform(errors, lambda e: 'error:' || e), list_transform(flags, lambda f: 'flag:' || f))) as counter from checked)
        select counter, count(*) as rows from c where counter is not null group by 1""",
)
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.summary(checked(spark, folder))


@query(
    "duplicate_review_groups",
    f"""with {CHECKED} select cast(year as varchar) as year, float_number, location_normalized, id, finder, location_raw, date_found, url
        from checked where list_contains(flags, 'duplicate_float_year_location')""",
)
def duplicate_review_groups(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_review(checked(spark, folder)).withColumn("year", F.col("year").cast("string"))


@query(
    "unresolved_titles",
    f"""with {CHECKED} select id, coalesce(cast(year as varchar), '') as year, finder, location_raw, url
        from checked where list_contains(errors, 'invalid_float_number')""",
)
def unresolved_titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.unresolved_titles(checked(spark, folder))
    return rows.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("")))


@query(
    "dup_exact_flag",
    "select doc_id, count(*) over (partition by text) > 1 as is_copy from documents",
)
def dup_exact_flag(spark: SparkSession, folder: str) -> DataFrame:
    digests = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    sized = grouping.with_group_size(digests, ["digest"], "copies")
    return sized.select("doc_id", (F.col("copies") > 1).alias("is_copy"))


@query(
    "dup_key_flag",
    f"""with {views.FINDS} select id, status <> 'P' and count(*) over (partition by year, status = 'P', number, place) > 1 as repeated
        from finds""",
)
def dup_key_flag(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds(spark, folder).select("id", "year", F.when(F.col("status") != "P", F.col("number")).alias("number"), "place")
    sized = grouping.with_group_size(f, ["year", "number", "place"], "copies")
    return sized.select("id", (F.col("copies") > 1).alias("repeated"))


@query(
    "waive_errors",
    """select o_orderkey as id, case when s_suppkey is not null and s_suppkey % 2 = 0 then 'invalid_date'
        else 'invalid_date,invalid_float_number' end as errors from orders left join supplier on s_suppkey = o_orderkey""",
)
def waive_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("id"))
    both = F.array(F.lit("invalid_date"), F.lit("invalid_float_number"))
    kept = quality.waive(both, F.col("waivers"))
    return rows.join(waivers(spark, folder), "id", "left").select(F.col("key").alias("id"), joined_array(kept).alias("errors"))


def joined_array(c):
    return F.concat_ws(",", c)
