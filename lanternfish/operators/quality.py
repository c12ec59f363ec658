"""Row and cross-row validation of a reports table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rules, text
from ..sources.tables import scan_tolerant
from ..session import cut_lineage
from .grouping import repeated_keys, with_group_size
from .outliers import mark_outliers

# Penalties per error and per suspicious flag, first plausible season.
ERROR_PENALTY = 0.25
FLAG_PENALTY = 0.10
FIRST_SEASON = 2010

RAW_COLUMNS = [
    "id",
    "year",
    "float_number",
    "finder",
    "location_raw",
    "location_normalized",
    "date_found",
    "url",
    "image_url",
    "source",
]
EXACT_COLUMNS = ["year", "float_number", "finder", "location_raw", "date_found", "url", "image_url"]


def _codes(**conditions: Column) -> Column:
    """Array of the codes whose condition holds, in declared order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in conditions.items()]), lambda c: c.isNotNull())


def waive(errors: Column, waivers: Column) -> Column:
    """Errors without the waived ones."""
    return F.array_except(errors, F.coalesce(waivers, F.array().cast("array<string>")))


def row_errors(year: Column, date_malformed: Column, number: Column, image: Column, first: int, last: int) -> Column:
    return _codes(
        invalid_year=year.isNull() | (year < first) | (year > last),
        invalid_date=date_malformed,
        invalid_float_number=~text.number_format_ok(number),
        invalid_image_url=~text.url_is_valid(image),
    )


def confidence(errors: Column, flags: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - ERROR_PENALTY * F.size(errors) - FLAG_PENALTY * F.size(flags)), 2)


def normalize(raw: DataFrame, place_rules: rules.Rules, default_source: str) -> DataFrame:
    """Raw text columns -> typed and conformed columns next to a digest of the raw row. Narrow."""
    trimmed = scan_tolerant(raw, RAW_COLUMNS).select(
        *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in RAW_COLUMNS]
    )
    place = F.when(F.col("location_raw") != "", rules.place_label(F.col("location_raw"), place_rules)).otherwise(
        F.col("location_normalized")
    )
    return trimmed.select(
        "id",
        text.parse_year(F.col("year")).alias("year"),
        text.normalize_number(F.col("float_number")).alias("float_number"),
        "finder",
        "location_raw",
        place.alias("location_normalized"),
        dates.normalize_date(F.col("date_found")).alias("_date"),
        "url",
        "image_url",
        text.infer_source(F.col("source"), F.col("url"), default_source).alias("source"),
        F.sha2(F.to_json(F.struct(*EXACT_COLUMNS)), 256).alias("_exact"),
    ).select("*", text.first_integer(F.col("float_number")).alias("number_value"))


def validate(
    raw: DataFrame,
    place_rules: rules.Rules,
    waivers: DataFrame | None = None,
    default_source: str = "archive",
    first_season: int = FIRST_SEASON,
    last_season: int = 2100,
) -> DataFrame:
    """Raw reports -> conformed reports with errors, suspicious flags, validity and confidence.

    ``waivers``: (id, waivers array<string>). Waivers apply to row errors only: an extreme number
    cannot be waived. Cross-row facts are pre-aggregated together and joined back.
    """
    base = normalize(raw, place_rules, default_source).select(
        "*",
        F.nullif("float_number", F.lit("")).alias("_number"),
        F.nullif("location_normalized", F.lit("")).alias("_place"),
    )
    # all cross-row facts come from one narrow count of the rows that are alike in all of them: the source is normalised
    # once for it and once for the result
    alike = cut_lineage(base.groupBy("year", "number_value", "_number", "_place", F.unhex("_exact").alias("_digest")).agg(F.count("*").alias("_n")))
    copies = cut_lineage(repeated_keys(alike, ["_digest"], "_copies", "_n").select(F.lower(F.hex("_digest")).alias("_exact"), "_copies"))
    same_key = cut_lineage(repeated_keys(alike, ["year", "_number", "_place"], "_same_key", "_n"))
    rows = mark_outliers(base, "year", "number_value", among=alike)
    rows = with_group_size(rows, ["_exact"], "_copies", copies)
    rows = with_group_size(rows, ["year", "_number", "_place"], "_same_key", same_key)
    if waivers is not None:
        rows = rows.join(waivers.select("id", "waivers"), "id", "left")
    else:
        rows = rows.withColumn("waivers", F.array().cast("array<string>"))

    own = row_errors(
        F.col("year"), F.col("_date.malformed"), F.col("float_number"), F.col("image_url"), first_season, last_season
    )
    errors = F.concat(waive(own, F.col("waivers")), _codes(extreme_float_number_outlier=F.col("is_outlier")))
    flags = _codes(
        malformed_date_string=F.col("_date.malformed"),
        blank_float_with_hash_finder=(F.col("float_number") == "") & F.col("finder").startswith("#"),
        duplicate_exact_row=F.col("_copies") > 1,
        duplicate_float_year_location=F.col("_same_key") > 1,
    )
    checked = rows.select(
        "id",
        "year",
        "float_number",
        "finder",
        "location_raw",
        "location_normalized",
        F.col("_date.value").alias("date_found"),
        "url",
        "image_url",
        "source",
        errors.alias("errors"),
        flags.alias("suspicious_flags"),
    )
    return checked.select(
        "*",
        (F.size("errors") == 0).alias("is_valid"),
        confidence(F.col("errors"), F.col("suspicious_flags")).alias("confidence_score"),
    )


def is_flagged() -> Column:
    return ~F.col("is_valid") | (F.size("suspicious_flags") > 0)


def summary(checked: DataFrame) -> DataFrame:
    """All counters of a run as (counter, rows), from one pass over the rows."""
    suspicious = F.size("suspicious_flags") > 0
    counters = F.concat(
        F.array(F.lit("total_rows")),
        F.filter(
            F.array(
                F.when(F.col("is_valid"), F.lit("valid_rows")).otherwise(F.lit("invalid_rows")),
                F.when(suspicious, F.lit("suspicious_rows")),
                F.when(is_flagged(), F.lit("flagged_rows")),
            ),
            lambda c: c.isNotNull(),
        ),
        F.transform("errors", lambda e: F.concat(F.lit("error:"), e)),
        F.transform("suspicious_flags", lambda f: F.concat(F.lit("flag:"), f)),
    )
    return checked.select(F.explode(counters).alias("counter")).groupBy("counter").agg(F.count("*").alias("rows"))


def duplicate_review(checked: DataFrame) -> DataFrame:
    """Members of duplicate groups, one row each: a group is never collected into one value."""
    return checked.where(F.array_contains("suspicious_flags", "duplicate_float_year_location")).select(
        "year", "float_number", "location_normalized", "id", "finder", "location_raw", "date_found", "url"
    )


def unresolved_titles(checked: DataFrame) -> DataFrame:
    return checked.where(F.array_contains("errors", "invalid_float_number")).select(
        "id", "year", "finder", "location_raw", "url"
    )
