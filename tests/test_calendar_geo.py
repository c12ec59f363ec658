import datetime as dt
import math

from pyspark.sql import functions as F

from lanternfish.functions import calendar as cal
from lanternfish.functions import geo


def days(*texts):
    return [dt.date.fromisoformat(t) for t in texts]


def test_holidays(column):
    d = days("2026-07-03", "2026-07-04", "2021-12-31", "2025-11-27", "2025-05-26", "2026-01-01", "2025-10-13", "2026-07-02")
    assert column(cal.is_holiday, d, "date") == [True, False, False, True, True, True, True, False]


def test_long_weekends(column):
    d = days("2026-07-03", "2026-07-04", "2021-12-31", "2022-01-01", "2025-11-28", "2026-07-02", "2026-07-06", "2023-01-02")
    assert column(cal.is_long_weekend, d, "date") == [True, True, True, True, True, False, False, True]


def test_moon_against_plain_arithmetic(column):
    d = [dt.date(1990, 1, 1) + dt.timedelta(days=37 * i) for i in range(300)]
    position = [((x - dt.date(2000, 1, 6)).days % 29.53058867) / 29.53058867 for x in d]
    light = column(cal.moon_illumination, d, "date")
    assert all(abs(a - 0.5 * (1 - math.cos(2 * math.pi * p))) < 6e-5 for a, p in zip(light, position))
    names = column(cal.moon_phase, d, "date")
    assert all(n == cal.PHASES[int(p * 8 + 0.5) % 8] for n, p in zip(names, position))


def test_distances(column):
    miles = column(lambda c: geo.haversine_miles(F.lit(41.17), F.lit(-71.58), c, F.lit(-71.58)), [41.17, 42.17], "double")
    assert miles[0] == 0 and abs(miles[1] - 3959 * math.pi / 180) < 1e-6
    assert column(geo.distance_label, [0.05, 0.1, 2.34], "double") == ["Under 0.1 mi away", "0.1 mi away", "2.3 mi away"]


def test_speeds(spark):
    rows = [(38.88, "wmoUnit:km_h-1", 24), (10.0, "knots", 12), (7.4, "x:mph", 7), (10.0, None, 22), (10.0, "m/s", 22)]
    df = spark.createDataFrame(rows, "v double, u string, want int")
    for r in df.select("want", geo.speed_to_mph(F.col("v"), F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_text_scalars(column):
    assert column(geo.mean_of_numbers, ["10 to 15 mph", "7 mph", "calm", None]) == [12, 7, None, None]
    assert column(geo.compass_bucket, ["230", "0", "359", "variable", "", "-10"]) == ["SW", "N", "N", "variable", None, "N"]
    assert column(lambda c: geo.celsius_to_fahrenheit(c, F.lit(50)), [20.0, None], "double") == [68, 50]
