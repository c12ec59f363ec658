from pyspark.sql import functions as F

from lanternfish.functions import rules
from lanternfish.operators import dedupe
from lanternfish.schema import RECORD

RULES = (("hollow", "The Hollow"),)


def label():
    return rules.place_label(F.col("location"), RULES)


def test_pair_is_merged(spark):
    rows = [
        ("1039", "2024", "332 L. Marsh", "u1", "", "The Hollow", ""),
        ("3931", "2024", "332", "u2", "https://i.org/a.jpg", "hollow", "2024-07-08"),
        ("7", "2024", "332 Else", "u3", "", "nowhere", ""),
        ("8", "2024", "332 Else", "u4", "", "nowhere", ""),
    ]
    df = spark.createDataFrame(rows, RECORD)
    merged = {r["id"]: r for r in dedupe.merge_duplicates(df, label()).collect()}
    assert set(merged) == {"3931", "7", "8"}
    kept = merged["3931"]
    assert (kept["title"], kept["date_found"], kept["location"], kept["image"]) == (
        "332 L. Marsh", "2024-07-08", "The Hollow", "https://i.org/a.jpg",
    )
    report = dedupe.merge_report(df, label()).collect()
    assert sorted((r["kept_id"], r["merged_id"]) for r in report) == [("3931", "1039"), ("3931", "3931")]


def test_real_image_beats_placeholder(spark):
    rows = [
        ("1", "2024", "5 Ann", "u", "https://i.org/default_image_2__x.jpg", "hollow", "2024-01-02"),
        ("2", "2024", "5 Not Specified", "u", "https://i.org/b.jpg", "hollow", ""),
    ]
    row = dedupe.merge_duplicates(spark.createDataFrame(rows, RECORD), label()).first()
    assert row["id"] == "1" and row["image"] == "https://i.org/b.jpg" and row["title"] == "5 Ann"
