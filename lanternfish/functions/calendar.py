"""Calendar, holiday and moon features of a DATE column. Pure expressions: no join, no shuffle."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Moon reference day, synodic month, phase names from position 0 on.
NEW_MOON = "2000-01-06"
SYNODIC_MONTH = 29.53058867
PHASES = (
    "new",
    "waxing_crescent",
    "first_quarter",
    "waxing_gibbous",
    "full",
    "waning_gibbous",
    "last_quarter",
    "waning_crescent",
)


def weekday(d: Column) -> Column:
    """Monday = 0."""
    return F.weekday(d)


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def _nth(year: Column, month: int, day_name: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), day_name), 7 * (n - 1))


def _observed(year: Column, month: int, day: int) -> Column:
    date = F.make_date(year, F.lit(month), F.lit(day))
    return F.date_add(date, F.when(F.weekday(date) == 5, -1).when(F.weekday(date) == 6, 1).otherwise(0))


def federal_holidays(year: Column) -> list[Column]:
    """The 11 US federal holidays of a year; fixed-date ones on their observed day."""
    last_monday_of_may = F.next_day(F.make_date(year, F.lit(5), F.lit(24)), "Mon")
    return [
        _observed(year, 1, 1),
        _nth(year, 1, "Mon", 3),
        _nth(year, 2, "Mon", 3),
        last_monday_of_may,
        _observed(year, 6, 19),
        _observed(year, 7, 4),
        _nth(year, 9, "Mon", 1),
        _nth(year, 10, "Mon", 2),
        _observed(year, 11, 11),
        _nth(year, 11, "Thu", 4),
        _observed(year, 12, 25),
    ]


def is_holiday(d: Column) -> Column:
    """Holiday of its own calendar year: an observed New Year on December 31st does not count."""
    return d.isin(*federal_holidays(F.year(d)))


def is_long_weekend(d: Column) -> Column:
    """Friday to Monday within a day of a holiday.

    Of the neighbouring years only the next New Year can lie within a day.
    """
    days = federal_holidays(F.year(d)) + [_observed(F.year(d) + 1, 1, 1)]
    near = reduce(lambda a, b: a | b, [F.abs(F.datediff(d, day)) <= 1 for day in days])
    return F.weekday(d).isin(4, 5, 6, 0) & near


def moon_position(d: Column) -> Column:
    days = F.datediff(d, F.lit(NEW_MOON).cast("date")).cast("double")
    return F.pmod(days, F.lit(SYNODIC_MONTH)) / F.lit(SYNODIC_MONTH)


def moon_illumination(d: Column) -> Column:
    return F.round(0.5 * (1 - F.cos(2 * math.pi * moon_position(d))), 4)


def moon_phase(d: Column) -> Column:
    eighth = F.floor(moon_position(d) * 8 + 0.5).cast("int") % len(PHASES)
    return F.when(d.isNotNull(), F.element_at(F.array(*[F.lit(p) for p in PHASES]), eighth + 1))


def moon_bucket(illumination: Column) -> Column:
    return F.when(illumination < 0.25, "dark").when(illumination < 0.6, "balanced").otherwise("bright")


def sin_day(day_of_year: Column) -> Column:
    return F.sin(2 * math.pi * day_of_year / 365.0)


def cos_day(day_of_year: Column) -> Column:
    return F.cos(2 * math.pi * day_of_year / 365.0)


def calendar_columns(d: Column) -> list[Column]:
    return [
        F.dayofyear(d).alias("day_of_year"),
        F.month(d).alias("month"),
        weekday(d).alias("weekday"),
        weekday_name(d).alias("weekday_name"),
        is_weekend(d).alias("is_weekend"),
        is_holiday(d).alias("is_holiday"),
        is_long_weekend(d).alias("is_long_weekend"),
        moon_phase(d).alias("moon_phase"),
        moon_illumination(d).alias("moon_illumination"),
        moon_bucket(moon_illumination(d)).alias("moon_bucket"),
    ]
