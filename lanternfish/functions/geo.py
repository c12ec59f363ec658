"""Distance, unit and direction scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Earth radius in miles, speed factors to mph, compass names.
EARTH_RADIUS_MILES = 3959
KMH_TO_MPH = 0.621371
KNOT_TO_MPH = 1.15078
MS_TO_MPH = 2.23694
COMPASS = (
    "N",
    "NNE",
    "NE",
    "ENE",
    "E",
    "ESE",
    "SE",
    "SSE",
    "S",
    "SSW",
    "SW",
    "WSW",
    "W",
    "WNW",
    "NW",
    "NNW",
)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return EARTH_RADIUS_MILES * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_label(miles: Column) -> Column:
    return F.when(miles < 0.1, F.lit("Under 0.1 mi away")).otherwise(
        F.concat(F.format_string("%.1f", F.bround(miles, 1)), F.lit(" mi away"))
    )


def speed_to_mph(value: Column, unit: Column) -> Column:
    """Unit text decides the factor; blank or unknown units are metres per second."""
    code = F.lower(F.trim(F.coalesce(unit, F.lit(""))))

    def has(*tokens: str) -> Column:
        return code.rlike("|".join(tokens))

    factor = (
        F.when(has("km_h-1", "km/h", "kilometer per hour"), KMH_TO_MPH)
        .when(has("kn", "knot"), KNOT_TO_MPH)
        .when(has("mi_h-1", "mile per hour", ":mph$"), 1.0)
        .otherwise(MS_TO_MPH)
    )
    return F.bround(value.try_cast("double") * factor, 0).cast("int")


def mean_of_numbers(text: Column) -> Column:
    """"10 to 15 mph" -> 12 (half-even); null without numbers."""
    chunks = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9.\-]+", " ")), " +")
    values = F.filter(F.transform(chunks, lambda x: x.try_cast("double")), lambda x: x.isNotNull())

    def mean(numbers: Column) -> Column:
        total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(numbers) > 0, F.bround(total / F.size(numbers), 0).cast("int"))

    return let(values, mean)


def compass_bucket(degrees: Column) -> Column:
    """Degrees -> one of 16 names; other text passes through; blank is null."""
    text = F.trim(degrees.cast("string"))
    value = F.pmod(text.try_cast("double"), F.lit(360.0))
    index = F.floor((value + 11.25) / 22.5).cast("int") % 16
    # element_at with a null index would return the last name, hence the explicit branch
    name = F.when(value.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in COMPASS]), index + 1))
    return F.when(text == "", F.lit(None)).otherwise(F.coalesce(name, text))


def celsius_to_fahrenheit(celsius: Column, fallback: Column) -> Column:
    return F.coalesce(F.bround(celsius * 9 / 5 + 32, 0).cast("int"), fallback)
