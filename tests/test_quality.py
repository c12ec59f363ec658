import pytest

from lanternfish.operators import quality

RULES = (("clay", "Clay Head"), ("hollow", "The Hollow"))
COLUMNS = "id string, year string, float_number string, finder string, location_raw string, location_normalized string, date_found string, url string, image_url string"
BASE = ("2025", "12", "Ann", "clay head trail", "", "2025-06-01", "https://www.a.org/1", "https://i.org/1.jpg")


@pytest.fixture
def checked(spark):
    rows = [
        ("1", *BASE),
        ("2", "2025", "", "#421 Bob", "the hollow", "", "2025-06-02", "https://a.org/2", ""),
        ("3", "2025", "77", "Cat", "", "Stored place", "13/45/2025", "x", "not-a-url"),
        ("4", *BASE),
        ("5", "1999", "abc", "Dee", "hollow", "", "", "", ""),
        *[(str(10 + i), "2024", str(n), "F", "hollow", "", "", "", "") for i, n in enumerate((546, 550, 551, 552, 553, 558, 2044))],
    ]
    waivers = spark.createDataFrame(
        [("5", ["invalid_float_number"]), ("16", ["extreme_float_number_outlier"])], "id string, waivers array<string>"
    )
    df = quality.validate(spark.createDataFrame(rows, COLUMNS), RULES, waivers, "archive", 2010, 2027)
    return {r["id"]: r for r in df.collect()}, df


def test_rows(checked):
    rows, _ = checked
    assert rows["1"]["errors"] == [] and rows["1"]["suspicious_flags"] == ["duplicate_exact_row", "duplicate_float_year_location"]
    assert rows["1"]["source"] == "a.org" and rows["1"]["location_normalized"] == "Clay Head"
    assert rows["1"]["confidence_score"] == 0.8 and rows["1"]["is_valid"]
    assert rows["2"]["errors"] == ["invalid_float_number"] and rows["2"]["suspicious_flags"] == ["blank_float_with_hash_finder"]
    assert rows["2"]["confidence_score"] == 0.65 and not rows["2"]["is_valid"]
    assert rows["3"]["errors"] == ["invalid_date", "invalid_image_url"] and rows["3"]["suspicious_flags"] == ["malformed_date_string"]
    assert rows["3"]["location_normalized"] == "Stored place" and rows["3"]["date_found"] == "13/45/2025"


def test_waivers(checked):
    rows, _ = checked
    assert rows["5"]["errors"] == ["invalid_year"]
    assert rows["16"]["errors"] == ["extreme_float_number_outlier"], "an extreme number cannot be waived"
    assert rows["15"]["errors"] == []


def test_summary(checked):
    rows, df = checked
    counters = {r["counter"]: r["rows"] for r in quality.summary(df).collect()}
    assert counters["total_rows"] == 12 and counters["valid_rows"] == 8 and counters["invalid_rows"] == 4
    assert counters["suspicious_rows"] == 4 and counters["flagged_rows"] == 6
    assert counters["flag:duplicate_exact_row"] == 2 and counters["error:invalid_date"] == 1


def test_absent_columns_are_blank(spark):
    df = spark.createDataFrame([("1", "2025", "7")], "id string, year string, float_number string")
    row = quality.validate(df, RULES, last_season=2027).first()
    assert row["errors"] == [] and row["source"] == "archive"


def test_source_is_read_twice_at_most(spark, tmp_path):
    """Once for the facts across rows, once for the result: validation of a table of one file opens it twice."""
    from conftest import SMALL
    from lanternfish.operators import quality
    from lanternfish.plans import quality as plans

    raw = plans.raw_reports(spark, SMALL)
    read = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(raw.rdd.map(lambda r: (read.add(1), r)[1]), raw.schema)
    rows = raw.count()
    checked = quality.validate(counted, plans.PLACE_RULES, plans.waivers(spark, SMALL), "archive", plans.FIRST_SEASON, plans.LAST_SEASON)
    assert quality.summary(checked).count() > 3
    assert rows <= read.value <= 2 * rows


def test_output_checks_deal_their_keys_to_tasks(spark, monkeypatch):
    """Memory of a task follows the number of keys, not their compressed bytes; the findings are the same."""
    from conftest import SMALL

    from lanternfish.operators import checks
    from lanternfish.plans.catalog import QUERIES

    together = sorted(map(tuple, QUERIES["output_checks"](spark, SMALL).collect()))
    monkeypatch.setattr(checks, "KEYS_PER_TASK", 100)
    assert sorted(map(tuple, QUERIES["output_checks"](spark, SMALL).collect())) == together and together
    ids = spark.range(1000).select("id")
    drift = checks.reconcile_ids(ids, ids.where("id < 990"), ["id"], tasks=7)
    assert drift.rdd.getNumPartitions() == 7 and drift.count() == 10
