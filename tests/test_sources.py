import json

import pytest

from lanternfish.operators.overrides import apply_overrides
from lanternfish.schema import RECORD
from lanternfish.sources import tables


def row(key, year, **more):
    return {**dict.fromkeys(RECORD.names, ""), "id": key, "year": year, **more}


def test_array_file_or_snapshots(spark, tmp_path):
    (tmp_path / "all.json").write_text("[]")
    (tmp_path / "snap_2012.json").write_text(json.dumps([row("1", "2012")]))
    (tmp_path / "snap_2026.json").write_text(json.dumps([row("2", "2026"), row("3", "2026")]))
    got = tables.read_records_or_snapshots(spark, str(tmp_path / "all.json"), str(tmp_path / "snap_*.json"))
    assert [r["id"] for r in tables.sort_records(got).collect()] == ["3", "2", "1"]
    (tmp_path / "all2.json").write_text(json.dumps([row("9", "2020")]))
    got = tables.read_records_or_snapshots(spark, str(tmp_path / "all2.json"), str(tmp_path / "snap_*.json"))
    assert [r["id"] for r in got.collect()] == ["9"]


def test_overrides(spark, tmp_path):
    (tmp_path / "o.json").write_text(
        json.dumps(
            {
                "1": {"title_override": " New ", "location_override": None, "validation_waivers": ["a", " b ", "", None]},
                "2": {"validation_waivers": "single", "image_override": ""},
                "3": "not an object",
                "4": {"year_override": 2020, "other": "x"},
            },
            indent=2,
        )
    )
    overrides = tables.read_overrides(spark, str(tmp_path / "o.json"))
    got = {r["id"]: (r["fields"], r["waivers"]) for r in overrides.collect()}
    assert got == {
        "1": ({"title_override": "New", "location_override": ""}, ["a", "b"]),
        "2": ({"image_override": ""}, ["single"]),
        "4": ({"year_override": "2020"}, []),
    }
    rows = spark.createDataFrame(
        [("1", "2012", "Old", "u", "i", "here", "d"), ("2", "2012", "Old", "u", "i", "here", "d"), ("5", "2012", "Old", "u", "i", "here", "d")], RECORD
    )
    done = {r["id"]: r for r in apply_overrides(rows, overrides).collect()}
    assert (done["1"]["title"], done["1"]["location"], done["1"]["waivers"]) == ("New", "", ["a", "b"])
    assert done["2"]["image"] == "" and done["5"]["title"] == "Old" and done["5"]["waivers"] == []


def test_listing_xml(spark, tmp_path):
    (tmp_path / "map.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
        "<url><loc> https://h.org/event/a/3633/ </loc><lastmod>2026-01-02</lastmod></url>"
        "<url><loc>https://h.org/event/b/5741</loc></url><url><loc>https://h.org/blog/9/</loc></url></urlset>"
    )
    got = [tuple(r) for r in tables.read_listing_xml(spark, str(tmp_path / "map.xml")).collect()]
    assert got == [("5741", "https://h.org/event/b/5741", ""), ("3633", "https://h.org/event/a/3633/", "2026-01-02")]


def test_run_scoped_write_is_idempotent(spark, tmp_path):
    rows = spark.range(5)
    for run in ("a", "b", "a"):
        tables.write_run(rows, str(tmp_path / "runs"), run)
    got = spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().collect()
    assert sorted(tuple(r) for r in got) == [("a", 5), ("b", 5)]


def record_rows(n):
    text = 'a },\n "quoted" [x], { ' + chr(8212)
    return [(str(k), "2024", f"{k} {text}", "u", "i" if k % 2 else None, "]", "2024-05-05") for k in range(n)]


def test_one_array_is_read_by_several_tasks(spark, tmp_path):
    rows = record_rows(400)
    names = RECORD.names
    path = tmp_path / "records.json"
    path.write_text(json.dumps([dict(zip(names, r)) for r in rows], indent=2, ensure_ascii=False), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = tables.read_records(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("style", [{"indent": None}, {"indent": 4}, {"indent": 0}, {"separators": (",\n", ":")}])
def test_arrays_of_any_layout(spark, tmp_path, style):
    rows = record_rows(5)
    for name, some in (("some", rows), ("none", []), ("one", rows[:1])):
        text = json.dumps([dict(zip(RECORD.names, r)) for r in some], **style)
        (tmp_path / name).write_text(text.replace("\n", "\r\n") if name == "one" else text)
        assert sorted(tuple(r) for r in tables.read_records(spark, str(tmp_path / name)).collect()) == sorted(some)
    found = tables.read_records_or_snapshots(spark, str(tmp_path / "none"), str(tmp_path / "[so]*e"))
    assert found.count() == 6


@pytest.mark.parametrize("indent", [None, 2])
def test_whole_override_objects(spark, tmp_path, indent):
    entries = {"7": {"title_override": " T },\n { ", "validation_waivers": [" a ", ""]}, "8": "text", "9": {"notes": None, "validation_waivers": "b"}, "10": 3, "11": {}}
    (tmp_path / "o.json").write_text(json.dumps(entries, indent=indent))
    got = {r["id"]: (r["fields"], r["waivers"]) for r in tables.read_overrides(spark, str(tmp_path / "o.json")).collect()}
    assert got == {"7": ({"title_override": "T },\n {"}, ["a"]), "9": ({"notes": ""}, ["b"]), "11": ({}, [])}
