import pytest

from lanternfish.operators import ingest
from lanternfish.schema import RECORD, STATE

NOW = "2026-07-01T00:00:00+00:00"
FULL = ("2026", "1 Ann", "u{0}", "i", "place", "2026-05-05")


def record(key, **change):
    row = dict(zip(RECORD.names, (str(key), "2026", "1 Ann", f"u{key}", "i", "place", "2026-05-05")))
    return tuple({**row, **change}.values())


def frames(spark, listing, records, state, fetched=None):
    parts = [
        spark.createDataFrame([(str(k), f"u{k}", m) for k, m in listing], "id string, url string, sitemap_lastmod string"),
        spark.createDataFrame(records, RECORD),
        spark.createDataFrame(state, STATE),
    ]
    if fetched is not None:
        kind = "id string, status_code int, rejection string, warning string, record struct<year:string,title:string,url:string,image:string,location:string,date_found:string>"
        parts.append(spark.createDataFrame(fetched, kind))
    return parts


def tracked(key, lastmod, fetched="", status="ok", url=None):
    return (str(key), url or f"u{key}", lastmod, "2026-01-01", "2026-06-01", fetched, status)


@pytest.fixture
def sources(spark):
    listing = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    records = [record(2), record(3), record(4, image=""), record(5), record(9)]
    state = [tracked(2, "old"), tracked(3, "c"), tracked(4, "d"), tracked(5, "", status="bootstrap"), tracked(9, "z")]
    return listing, records, state


def test_classes(spark, sources):
    got = {r["id"]: r["change"] for r in ingest.classify_changes(*frames(spark, *sources)).collect()}
    assert got == {"1": "new", "2": "changed", "3": "unchanged", "4": "incomplete", "5": "unchanged"}


def test_backfill_is_capped_and_rotates(spark):
    listing = [(k, "m") for k in range(1, 41)]
    records = [record(k, date_found="") for k in range(1, 41)]
    state = [tracked(k, "m", fetched=("" if k % 2 else f"2026-0{1 + k % 5}-01")) for k in range(1, 41)]
    classified = ingest.classify_changes(*frames(spark, listing, records, state))
    got = {int(r["id"]) for r in ingest.select_work(classified).collect()}
    assert len(got) == 25 and set(range(1, 41, 2)) <= got
    oldest = {k for k in range(2, 41, 2) if k % 5 == 0}
    assert oldest <= got


def test_modes(spark, sources):
    classified = ingest.classify_changes(*frames(spark, *sources))
    assert {r["id"] for r in ingest.select_work(classified, "new-only").collect()} == {"1"}
    full = {r["id"]: r["reason"] for r in ingest.select_work(classified, "full").collect()}
    assert full == {"1": "new", "2": "changed", "3": "forced", "4": "backfill", "5": "forced"}
    with pytest.raises(ValueError):
        ingest.select_work(classified, "sometimes")


def test_upsert_and_state(spark, sources):
    fresh = ("2026", "1 New", "u1", "i", "place", "2026-06-30")
    fetched = [("1", 200, "", "", fresh), ("2", 404, "", "", None), ("4", 0, "", "", None)]
    joined = ingest.join_sources(*frames(spark, *sources, fetched))
    records = {r["id"]: r for r in ingest.merge_upsert(joined).collect()}
    assert set(records) == {"1", "2", "3", "4", "5", "9"}
    assert records["1"]["title"] == "1 New" and records["2"]["title"] == "1 Ann"
    state = {r["id"]: r for r in ingest.next_state(joined, NOW).collect()}
    status = {k: r["fetch_status"] for k, r in state.items()}
    assert status == {"1": "ok", "2": "http_404", "3": "ok", "4": "request_error", "5": "cached", "9": "missing_from_sitemap"}
    assert state["1"]["first_seen_at"] == NOW and state["2"]["first_seen_at"] == "2026-01-01"
    assert state["9"]["last_seen_at"] == "2026-06-01" and state["3"]["last_fetched_at"] == ""
    assert state["2"]["sitemap_lastmod"] == "b"


def test_new_only_keeps_the_old_listing_values(spark, sources):
    joined = ingest.join_sources(*frames(spark, *sources, []))
    state = {r["id"]: r for r in ingest.next_state(joined, NOW, "new-only").collect()}
    assert state["2"]["sitemap_lastmod"] == "old", "a skipped change must still count as changed next time"
    assert state["1"]["fetch_status"] == "discovered"


def test_rejection_and_warning(spark, sources):
    fresh = ("2026", "1 New", "u1", "i", "place", "2026-06-30")
    fetched = [("1", 200, "", "implausible_season_year", fresh), ("2", 200, "non_float_event", "", None), ("4", 503, "", "", None)]
    parts = frames(spark, *sources, fetched)
    joined = ingest.join_sources(*parts)
    work = ingest.select_work(ingest.classify_changes(*parts[:3]))
    row = ingest.ingest_report(joined, work).first().asDict()
    assert (row["listed"], row["fetched"], row["reused"], row["new"], row["changed"]) == (5, 3, 2, 1, 1)
    assert (row["non_float_event"], row["implausible_season_year"], row["request_error"]) == (1, 1, 1)
    assert (row["missing_from_sitemap"], row["backfilled"], row["forced"]) == (1, 1, 0)


def test_enrich(spark):
    rows = spark.createDataFrame([("1", "2026", "", "", "", "here", "2026-01-09")], RECORD)
    old = spark.createDataFrame([record(1)], RECORD)
    got = ingest.enrich_from_previous(rows, old).first()
    assert (got["title"], got["url"], got["location"], got["date_found"]) == ("1 Ann", "u1", "here", "2026-05-05")
