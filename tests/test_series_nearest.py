import datetime as dt
import math
import random

from lanternfish.operators import nearest, series

START = dt.datetime(2024, 1, 1)


def test_series_against_brute_force(spark):
    rng = random.Random(3)
    readings, probes = [], []
    for station in range(4):
        # station 0 holds most rows; gaps of several days occur
        for _ in range(300 if station == 0 else 12):
            t = START + dt.timedelta(minutes=rng.randrange(0, 20 * 1440), seconds=7)
            readings.append((station, t, round(rng.random() * 5, 2), len(readings)))
        probes += [(station, START + dt.timedelta(hours=rng.randrange(0, 500))) for _ in range(25)]
    probes = sorted(set(probes))
    r = spark.createDataFrame(readings, "station int, ts timestamp_ntz, height double, event_id long")
    p = spark.createDataFrame(probes, "station int, probe_ts timestamp_ntz")
    got = {(x["station"], x["probe_ts"]): x for x in series.tide_context(p, r).collect()}
    seen = 0
    for station, at in probes:
        line = sorted((t, i, h) for s, t, h, i in readings if s == station and at - dt.timedelta(hours=12) <= t <= at + dt.timedelta(hours=18))
        if not line:
            assert (station, at) not in got
            continue
        seen += 1
        k = min(range(len(line)), key=lambda j: abs(line[j][0] - at))
        rising = line[min(k + 1, len(line) - 1)][2] >= line[max(k - 1, 0)][2]
        heights = [h for _, _, h in line]
        x = got[(station, at)]
        assert x["height_now"] == round(line[k][2], 2)
        assert x["stage"] == ("rising" if rising else "falling")
        assert abs(x["daily_range"] - (max(heights) - min(heights))) < 0.006
    assert seen > 40


def miles(a, b):
    p = [math.radians(x) for x in (*a, *b)]
    h = math.sin((p[2] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(p[2]) * math.sin((p[3] - p[1]) / 2) ** 2
    return 3959 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_against_brute_force(spark):
    rng = random.Random(11)
    points = [(f"c{i}", rng.randrange(1, 5), 41.17, -71.58) for i in range(25)]  # a third on one spot
    points += [(f"n{i}", rng.randrange(1, 5), 41 + rng.random() / 20, -71 - rng.random() / 20) for i in range(25)]
    points += [(f"w{i}", 1, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(20)]
    points += [("east", 2, 10.0, 179.99), ("west", 2, 10.0, -179.99), ("pole", 1, 89.9, 10.0), ("pole2", 1, 89.9, -170.0)]
    df = spark.createDataFrame(points, "name string, reports int, lat double, lon double")
    got = {}
    for r in nearest.nearest_k(df, 3).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append(r["neighbor"])
    for name, _, lat, lon in points:
        want = sorted(
            (round(miles((lat, lon), (b, c)), 1), -n, other) for other, n, b, c in points if other != name
        )[:3]
        assert got[name] == [w[2] for w in want], name
    assert got["east"][0] == "west"


def test_fewer_places_than_k(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 1, 50.0, 50.0)], "name string, reports int, lat double, lon double")
    assert nearest.nearest_k(df, 5).count() == 2


def test_dense_places_meet_few_others(spark):
    """4,000 places within a few miles: exact lists, and a place is compared with those around it only."""
    rng = random.Random(5)
    points = [(f"d{i}", rng.randrange(1, 9), 41 + rng.random() / 40, -71 + rng.random() / 40) for i in range(4000)]
    df = spark.createDataFrame(points, "name string, reports int, lat double, lon double").cache()
    got = {}
    for r in nearest.nearest_k(df, 2).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append((r["neighbor"], r["miles"]))
    for name, _, lat, lon in points[:60]:
        want = sorted((round(miles((lat, lon), (b, c)), 1), -n, other) for other, n, b, c in points if other != name)[:2]
        assert got[name] == [(w[2], w[0]) for w in want], name
    probes = nearest._probes(nearest._bounds(df, 2))
    assert probes.join(nearest._at_levels(df), ["level", "cx", "cy"]).count() < 200 * len(points)
