from pyspark.sql import functions as F

from lanternfish.operators import archive, checks, grouping


def spots(spark, pairs):
    return spark.createDataFrame(pairs, "name string, reports long")


def tiers(df):
    return [(r["name"], r["tier"][0]) for r in df.orderBy("position").collect()]


def test_shortlist(spark):
    s = spots(spark, [(f"s{i:02d}", 100 - i) for i in range(20)])
    zones = spark.createDataFrame([("Z1", 1), ("Z2", 2)], "zone string, zone_rank int")
    members = spark.createDataFrame(
        [("Z1", "s10", 1), ("Z1", "s11", 2), ("Z1", "gone", 3), ("Z2", "s12", 1), ("Z2", "s13", 2), ("Z2", "s14", 3)],
        "zone string, name string, member_rank int",
    )
    got = tiers(archive.shortlist(s, zones, members))
    assert got[0] == ("s10", "1") and [n for n, t in got if t == "2"] == ["s11", "s12", "s13", "s14"]
    assert [n for n, t in got if t == "3"] == [f"s{i:02d}" for i in range(6)]


def test_shortlist_keeps_out_members_that_did_not_fit(spark):
    s = spots(spark, [(f"s{i}", 10 - i) for i in range(9)])
    zones = spark.createDataFrame([("Z", 1)], "zone string, zone_rank int")
    members = spark.createDataFrame([("Z", f"s{i}", i + 1) for i in range(6)], "zone string, name string, member_rank int")
    got = tiers(archive.shortlist(s, zones, members))
    assert [n for n, t in got if t == "2"] == ["s1", "s2", "s3", "s4"]
    assert [n for n, t in got if t == "3"] == ["s6", "s7", "s8"], "s5 is a zone member and stays out"


def test_shortlist_without_zones(spark):
    s = spots(spark, [(f"s{i}", 10 - i) for i in range(4)])
    zones = spark.createDataFrame([], "zone string, zone_rank int")
    members = spark.createDataFrame([], "zone string, name string, member_rank int")
    assert tiers(archive.shortlist(s, zones, members)) == [("s0", "1"), ("s1", "2"), ("s2", "2"), ("s3", "2")]


def test_search_by_label_but_not_with_hash(spark):
    rows = [(1, "Ann", "north beach", "North Beach"), (2, "Bob", "n. beach", "North Beach"), (3, "Cy", "hill", "Hill")]
    df = spark.createDataFrame(rows, "id int, finder string, raw string, label string")
    order = [F.col("id").desc()]
    found = lambda q: [r["id"] for r in archive.search(df, q, "North Beach", ["finder", "raw"], "label", order).collect()]
    assert found("n. beach") == [2, 1] and found("#n. beach") == [] and found(" ") == [] and found("CY") == [3, 2, 1]


def test_year_filter_values():
    assert [archive.parse_year_filter(x) for x in ("2024", 2024, "all", "", None, "x")] == [2024, 2024, None, None, None, None]


def test_group_size_with_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1), (5, "b", 2)], "id int, k string, m int")
    got = {r["id"]: r["n"] for r in grouping.with_group_size(df, ["k", "m"], "n").collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0, 5: 1}


def test_clusters(spark):
    rows = [("b", 3, 1.0, 1.0), ("a", 3, 1.0, 1.0), ("c", 1, 2.0, 1.0)] + [(f"m{i}", 1, 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "name string, reports long, lat double, lon double")
    big = archive.map_clusters(df).where("lat = 1.0").first()
    assert (big["label"], big["reports"], big["spot_count"], big["remaining_spots"]) == ("a area", 11, 7, 2)
    assert big["members"] == "a:3,b:3,m0:1,m1:1,m2:1"


def test_checks(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    got = {(r["id"], r["only_in"]) for r in checks.reconcile_ids(a, b, ["id"]).collect()}
    assert got == {(1, "left"), (3, "right")}
    assert [r["key"] for r in checks.key_coverage(a, "id", 1, 3).collect()] == [3]
