"""Explicit schemas of the archive tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The seven canonical record fields; a missing value is "" in files, null in Spark.
RECORD_FIELDS = ("id", "year", "title", "url", "image", "location", "date_found")

RECORD = T.StructType([T.StructField(name, T.StringType()) for name in RECORD_FIELDS])

# The fields of one crawl-state entry.
STATE_FIELDS = (
    "url",
    "sitemap_lastmod",
    "first_seen_at",
    "last_seen_at",
    "last_fetched_at",
    "fetch_status",
)

STATE = T.StructType(
    [T.StructField("id", T.StringType())] + [T.StructField(name, T.StringType()) for name in STATE_FIELDS]
)

# Override key -> overridden record field.
OVERRIDE_FIELDS = {
    "title_override": "title",
    "location_override": "location",
    "date_found_override": "date_found",
    "year_override": "year",
    "url_override": "url",
    "image_override": "image",
}

# Override keys that only touch the stored table.
DATABASE_OVERRIDES = {
    "float_number_override": "float_number",
    "finder_override": "finder",
    "location_normalized_override": "location_normalized",
}

UNKNOWN_PLACE = "Other/Unknown"
