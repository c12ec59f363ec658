"""Multi-format dates. Results are ISO text or DATE; junk never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Accepted formats per reader, in the order they are tried.
CANONICAL_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "M/d/yy")
QUALITY_FORMATS = ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/M/d")
LENIENT_FORMATS = ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy")

# Month tokens.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_TOKEN = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
ORDINAL = r"(?i)(\d{1,2})(st|nd|rd|th)"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

# What a text has to look like before its format is tried. A failed parse costs an
# exception inside the JVM, a failed match costs next to nothing.
SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,} +\d{1,2}, +\d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} +\d{1,2}, +\d{4}$",
    "MMMM yyyy": r"^[A-Za-z]{4,} +\d{4}$",
    "MMM yyyy": r"^[A-Za-z]{3} +\d{4}$",
}

# Two-digit years above this one belong to the previous century.
PIVOT_YEAR = 2068


def try_format(c: Column, pattern: str) -> Column:
    parsed = F.try_to_date(F.regexp_replace(c, " +", " ") if " " in pattern else c, pattern)
    if "yyyy" not in pattern:
        parsed = F.when(F.year(parsed) > PIVOT_YEAR, F.add_months(parsed, -1200)).otherwise(parsed)
    return F.when(c.rlike(SHAPES[pattern]), parsed)


def first_parsed(c: Column, patterns: tuple[str, ...]) -> Column:
    """The shapes exclude each other, so the order of the formats does not matter."""
    return F.coalesce(*[try_format(c, pattern) for pattern in patterns])


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def strip_ordinals(c: Column) -> Column:
    return F.regexp_replace(c, ORDINAL, "$1")


def before_t(c: Column) -> Column:
    return F.trim(F.substring_index(c, "T", 1))


def canonicalize_date(c: Column) -> Column:
    """ISO text or blank. An ISO January 1st means "day unknown" at the source and becomes blank."""

    def settle(value: Column) -> Column:
        known = F.when(value.endswith("-01-01"), F.lit("")).otherwise(value)
        return F.when(value.rlike(ISO_DATE), known).otherwise(
            F.coalesce(iso(first_parsed(value, CANONICAL_FORMATS)), F.lit(""))
        )

    return let(F.substring_index(F.trim(F.coalesce(c, F.lit(""))), "T", 1), settle)


def normalize_date(c: Column) -> Column:
    """struct(value, malformed): ISO text, or the raw text together with the malformed flag."""

    def settle(value: Column) -> Column:
        parsed = iso(first_parsed(value, QUALITY_FORMATS))
        return F.struct(
            F.coalesce(parsed, value).alias("value"),
            (parsed.isNull() & (value != "")).alias("malformed"),
        )

    return let(strip_ordinals(before_t(F.trim(F.coalesce(c, F.lit(""))))), settle)


def parse_date_lenient(c: Column) -> Column:
    """DATE; month-only texts become the first of the month; null when nothing fits."""
    return first_parsed(c, LENIENT_FORMATS)


def month_of_text(c: Column) -> Column:
    """Month number of a date text, else of the first month name in it, else null."""

    def month(value: Column) -> Column:
        token = F.lower(F.regexp_extract(value, MONTH_TOKEN, 1))
        by_name = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), token), F.lit(0))
        return F.coalesce(F.month(parse_date_lenient(value)), by_name.cast("int"))

    return let(strip_ordinals(F.trim(F.coalesce(c, F.lit("")))), month)


def local_timestamp_text(ts: Column) -> Column:
    """UTC instant -> "Jan 4, 2024 at 7:05 PM EST": local time of New York, the only zone whose names are known here."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts.cast("timestamp_ntz"))
    # a wall-clock value has no zone name; it follows from the offset against UTC
    offset = F.timestamp_diff("HOUR", ts.cast("timestamp_ntz"), local)
    name = F.when(offset == -4, F.lit("EDT")).otherwise(F.lit("EST"))
    return F.concat(F.date_format(local, "MMM d, yyyy 'at' h:mm a "), name)


def parse_instant(c: Column, zone: str = "America/New_York") -> Column:
    """ISO text with Z or offset -> UTC wall clock; naive text is read in the display zone."""
    text = F.trim(c)
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":")
    aware = F.try_to_timestamp(text).cast("timestamp")
    naive = F.convert_timezone(F.lit(zone), F.lit("UTC"), text.try_cast("timestamp_ntz"))
    return F.when(has_zone, F.convert_timezone(F.current_timezone(), F.lit("UTC"), aware.cast("timestamp_ntz"))).otherwise(
        naive
    )


def public_date(c: Column) -> Column:
    """"Oct 4, 2025" for ISO dates, "Unknown" for blanks, anything else as it is."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.try_to_date(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10)), "yyyy-MM-dd")
    return F.when(raw == "", F.lit("Unknown")).otherwise(F.coalesce(F.date_format(parsed, "MMM d, yyyy"), raw))
