import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import backtest, briefing, seasonal
from lanternfish.plans import forecast


def dated(spark, rows):
    return spark.createDataFrame(rows, "label string, date date, n long").withColumn("year", F.year("date"))


def test_even_months_score_five(spark):
    rows = [(dt.date(2025, m, 15),) for m in range(1, 13)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "d date")
    assert {r["score"] for r in seasonal.seasonality_by_month(df, "d").collect()} == {5.0}
    empty = seasonal.seasonality_by_month(df.where("false"), "d").collect()
    assert len(empty) == 12 and {r["score"] for r in empty} == {0.0}


def kernel(a, b):
    d = min(abs(a - b), 366 - abs(a - b))
    return math.exp(-d * d / (2 * 21 * 21))


def test_activity_covers_day_366(spark):
    counts = dated(spark, [("a", dt.date(2024, 12, 31), 3), ("b", dt.date(2025, 1, 1), 1)])
    got = {r["day"]: r["activity"] for r in seasonal.activity_index(counts).collect()}
    raw = {d: 3 * kernel(366, d) + kernel(1, d) for d in range(1, 367)}
    mean = sum(raw.values()) / 366
    assert len(got) == 366 and all(abs(got[d] - min(raw[d] / mean * 5, 10)) < 0.051 for d in raw)
    assert {r["activity"] for r in seasonal.activity_index(counts.where("false")).collect()} == {0.0}


def test_priors_need_ten_rows(spark):
    few = dated(spark, [("a", dt.date(2024, 3, d), 1) for d in range(1, 10)])
    assert seasonal.seasonal_priors(few).count() == 0
    more = few.unionByName(dated(spark, [("b", dt.date(2024, 9, 1), 1)]))
    got = seasonal.seasonal_priors(more)
    assert got.select("day").distinct().count() == 366
    assert all(abs(r["s"] - 1) < 1e-5 for r in got.groupBy("day").agg(F.sum("prior").alias("s")).collect())


def brute_kernel_metrics(rows):
    labels = sorted({r[0] for r in rows})
    hits1 = hits3 = total = 0
    loss = 0.0
    for fold in sorted({r[1].year for r in rows}):
        train = [r for r in rows if r[1].year != fold]
        for label, date, n in (r for r in rows if r[1].year == fold):
            day = date.timetuple().tm_yday
            raw = {x: 0.5 for x in labels}
            for other, when, k in train:
                raw[other] += k * kernel(when.timetuple().tm_yday, day)
            s = sum(raw.values())
            order = sorted(labels, key=lambda x: (-raw[x], x))
            total += n
            hits1 += n * (order[0] == label)
            hits3 += n * (label in order[:3])
            loss -= n * math.log(raw[label] / s)
    return total, hits1 / total, hits3 / total, loss / total


def test_backtest_against_brute_force(spark):
    rng = random.Random(2)
    cells = {}
    for _ in range(160):
        key = (f"z{rng.randrange(6)}", dt.date(2020 + rng.randrange(4), rng.randrange(1, 13), rng.randrange(1, 28)))
        cells[key] = cells.get(key, 0) + 1
    rows = [(a, b, n) for (a, b), n in cells.items()]
    got = {r["model"]: r for r in backtest.backtest(dated(spark, rows)).collect()}
    assert set(got) == {"global_topk", "month_frequency", "kernel_seasonal", "hybrid_zone"}
    total, top1, top3, loss = brute_kernel_metrics(rows)
    k = got["kernel_seasonal"]
    assert (k["rows"], k["classes"]) == (total, 6)
    assert abs(k["top1_accuracy"] - top1) < 1e-4 and abs(k["top3_accuracy"] - top3) < 1e-4 and abs(k["log_loss"] - loss) < 1e-4


def test_backtest_needs_data(spark):
    one_year = dated(spark, [("a", dt.date(2024, 3, 1), 9), ("b", dt.date(2024, 3, 2), 9)])
    assert backtest.backtest(one_year).count() == 0


@pytest.mark.parametrize("h3, hl, winner", [(0.221, 3.0, "hybrid_zone"), (0.219, 3.0, "kernel_seasonal"), (0.3, 3.6, "kernel_seasonal")])
def test_gate(spark, h3, hl, winner):
    rows = [("kernel_seasonal", 0.2, 3.5), ("hybrid_zone", h3, hl)]
    df = spark.createDataFrame(rows, "model string, top3_accuracy double, log_loss double")
    assert backtest.model_gate(df).first()["primary_model"] == winner


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("kernel_seasonal", 0.2, 3.5), ("hybrid_zone", 0.3, 3.0)], ("hybrid_zone", 0.3)),
        ([("kernel_seasonal", 0.2, 3.5), ("hybrid_zone", 0.1, 3.0)], ("kernel_seasonal", 0.2)),
        ([("kernel_seasonal", 0.25, 3.5)], ("kernel_seasonal", 0.25)),
        ([], ("kernel_seasonal", 0.0)),
    ],
)
def test_selected_model_brings_its_accuracy(spark, rows, want):
    measured = spark.createDataFrame(rows, "model string, top3_accuracy double, log_loss double")
    assert [tuple(r) for r in backtest.selection(measured).collect()] == [want]


def test_selected_model_decides_which_scores_count(spark):
    day = dt.date(2025, 6, 2)
    zone = lambda name, prior, calendar: (day, 153, name, prior, 20, 20, 4, "", name, ["trail"], calendar, 1.0, 1.0, 1.0, [], 2)
    scored = spark.createDataFrame(
        [zone("A", 0.5, 0.9), zone("B", 0.46, 1.2), zone("C", 0.1, 1.0), zone("D", 0.05, 1.0)],
        "date date, day int, zone string, prior double, support_count int, dated_support_count int, years int, best_months string, primary_spot string, "
        "tags array<string>, calendar_mult double, recency_mult double, tide_mult double, weather_mult double, reasons array<string>, live_features int",
    )
    priors = spark.createDataFrame([(152, "A", 0.5), (153, "A", 0.5)], "day int, label string, prior double")
    activity = spark.createDataFrame([(152, 5.0), (153, 5.0)], "day int, activity double")
    for model, accuracy, lead, band in (("hybrid_zone", 0.3, "B", "high"), ("kernel_seasonal", 0.15, "A", "medium")):
        selected = spark.createDataFrame([(model, accuracy)], "primary_model string, top3_accuracy double")
        rows = briefing.daily_briefing(scored, priors, activity, selected).orderBy("rank").collect()
        assert len(rows) == 3 and rows[0]["zone"] == lead and {r["confidence_band"] for r in rows} == {band}


def test_affinity_ratio(spark):
    # all of a's reports fall on Saturdays, b's on Mondays
    rows = [("a", dt.date(2025, 3, 1), 3), ("a", dt.date(2025, 3, 8), 1), ("b", dt.date(2025, 3, 3), 4)]
    got = {(r["label"], r["key"]): r["ratio"] for r in seasonal.calendar_affinity(dated(spark, rows)).collect()}
    assert got[("a", "weekday:Saturday")] == round((4 + 2 * 0.5) / 6 / 0.5, 4)
    assert got[("b", "weekday:Saturday")] == round((0 + 2 * 0.5) / 6 / 0.5, 4)
    assert got[("a", "holiday")] == 1.0 and ("a", "weekday:Friday") not in got


def forest_cells(labels=3, years=2, n=60, seed=4):
    rng = random.Random(seed)
    cells = {(f"z{rng.randrange(labels)}", dt.date(2020 + rng.randrange(years), rng.randrange(1, 13), 5)): 1 for _ in range(n)}
    return [(a, b, k) for (a, b), k in cells.items()]


def test_forest_distribution_sums_to_one(spark):
    counts = dated(spark, forest_cells())
    dist = backtest.dist_forest(counts, backtest.vocabulary(counts), trees=7).dense(backtest.fold_space(counts))
    sums = dist.groupBy("fold", "day_of_year", "month").agg(F.sum("p").alias("s"), F.count("*").alias("k")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 and r["k"] == 3 for r in sums)


def test_forest_learns_days_to_the_last_split(spark):
    # every day has a label of its own, the same in all years: no bound of depth or bins lets two days share a leaf
    days = [dt.date(2021, 1, 1) + dt.timedelta(d) for d in range(0, 360, 3)]
    rows = [(f"day{d.timetuple().tm_yday:03}", d.replace(year=y), 200) for d in days for y in (2021, 2022, 2023)]
    counts = dated(spark, rows)
    (row,) = backtest.forest_metrics(counts, trees=10).collect()
    assert row["top1_accuracy"] == 1.0 and row["rows"] == len(rows) * 200


def test_forest_without_two_labels_falls_back_to_counts(spark):
    counts = dated(spark, [("a", dt.date(2021, 3, 1), 5), ("b", dt.date(2022, 3, 1), 7)])
    dist = backtest.dist_forest(counts, backtest.vocabulary(counts), trees=3).dense(backtest.fold_space(counts)).collect()
    assert {(r["fold"], r["label"]): round(r["p"], 6) for r in dist} == {
        (2021, "a"): round(0.5 / 8, 6), (2021, "b"): round(7.5 / 8, 6), (2022, "a"): round(5.5 / 6, 6), (2022, "b"): round(0.5 / 6, 6)
    }
    assert backtest.forest_metrics(dated(spark, [("a", dt.date(2021, 3, 1), 5)]), trees=3).count() == 0


def test_best_split_against_brute_force():
    import numpy as np

    from lanternfish.operators import forest

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        v, label, w = rng.integers(0, 5, n).astype(float), rng.integers(0, 3, n), rng.integers(1, 5, n)

        def squares(mask):
            return sum(w[mask & (label == k)].sum() ** 2 for k in range(3)) / w[mask].sum()

        cuts = [(a + b) / 2 for a, b in zip(np.unique(v), np.unique(v)[1:])]
        got = forest.best_split(v, label, w)
        assert (got is None) == (not cuts)
        if cuts:
            assert abs(got[0] - max(squares(v <= c) + squares(v > c) for c in cuts)) < 1e-9
            assert abs(got[0] - squares(v <= got[1]) - squares(v > got[1])) < 1e-9


def test_floor_and_labels_without_rows(spark):
    # so many rows that the common value of absent labels lies below the floor
    rows = [("b", dt.date(2021, 3, 1), 10**10), ("c", dt.date(2022, 3, 1), 10**10), ("a", dt.date(2021, 4, 1), 1), ("d", dt.date(2023, 4, 1), 3)]
    counts = dated(spark, rows)
    dist = backtest.dist_global(backtest.fold_space(counts), backtest.vocabulary(counts))
    q, contexts, top = dist.floored()
    got = {(r["fold"], r["rank"]): r["label"] for r in top.collect()}
    assert got == {
        (2021, 1): "c", (2021, 2): "a", (2021, 3): "b", (2022, 1): "b", (2022, 2): "a", (2022, 3): "c", (2023, 1): "b", (2023, 2): "c", (2023, 3): "a"
    }
    for fold, raws in ((2021, [0, 0, 1e10, 3]), (2022, [1, 1e10, 0, 3]), (2023, [1, 1e10, 1e10, 0])):
        p = [(x + 0.5) / (sum(raws) + 2) for x in raws]
        total = sum(max(x, 1e-9) for x in p)
        r = contexts.where(F.col("fold") == fold).first()
        assert abs(r["confidence"] - max(p) / total) < 1e-12 and abs(r["rest_q"] - max(0.5 / (sum(raws) + 2), 1e-9) / total) < 1e-15


def test_bands_and_signals(spark):
    rows = [(0.2, 18, 3, 2, "high"), (0.2, 18, 3, 1, "medium"), (0.12, 8, 2, 0, "medium"), (0.09, 50, 9, 2, "low")]
    df = spark.createDataFrame(rows, "a double, s int, y int, f int, want string")
    band = briefing.confidence_band(F.col("a"), F.col("s"), F.col("y"), F.col("f"))
    assert all(r["want"] == r["got"] for r in df.select("want", band.alias("got")).collect())


def test_freshness(spark):
    rows = [(dt.datetime(2026, 1, 1, 0, 0), h) for h in (0, 5, 30, 50, 24 * 15)]
    df = spark.createDataFrame([(a + dt.timedelta(0), a + dt.timedelta(hours=h)) for a, h in rows], "a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(*briefing.freshness(F.col("a"), F.col("b"))).collect()]
    assert got == [("1 hour", False), ("5 hours", False), ("1 day", False), ("2 days", True), ("2 weeks", True)]


def test_multipliers(spark):
    df = spark.createDataFrame([(["waterfront"],), (["trail"],), (["town"],)], "tags array<string>")
    tide = lambda s, r: [x[0] for x in df.select(briefing.tide_multiplier(F.col("tags"), F.lit(s), F.lit(r))).collect()]
    assert tide("rising", 3.0) == [1.12, 0.97, 1.0]
    assert tide(None, None) == [1.0, 1.0, 1.0]
    air = briefing.weather_multiplier(F.col("tags"), F.lit(20), F.lit(10), F.lit(False))
    assert [x[0] for x in df.select(air).collect()] == [1.0, 1.04, 1.0]


def test_tide_of_a_date_orders_the_readings_of_its_station_only(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 30)
    rows = [(n, start + dt.timedelta(minutes=rng.randrange(4 * 1440)), rng.choice([3, 4, 5, 6, 7, None]), "view", rng.choice([None, rng.random() * 9])) for n in range(400)]
    rows.append((400, None, 1, "view", 1.0))
    rows.append((401, start - dt.timedelta(days=3), None, "view", 1.0))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes, context = [], forecast.series.tide_context
    monkeypatch.setattr(forecast.series, "tide_context", lambda p, r: sizes.append((p.count(), r.count())) or context(p, r))
    got = {str(r["date"]): (r["stage"], r["daily_range"]) for r in forecast.tide_by_date(spark, str(tmp_path)).collect()}
    r = forecast.shifted_readings(spark, str(tmp_path))
    noon = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    every = context(r.select("station", noon.alias("probe_ts")).distinct(), r).collect()
    lowest = {}
    for x in sorted(every, key=lambda x: -x["station"]):
        lowest[str(x["probe_ts"])[:10]] = (x["stage"], x["daily_range"])
    assert got == lowest and len(got) == 4
    assert len(sizes) == 1 and sizes[0][0] == 4 and sizes[0][1] < 200
