import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from lanternfish.plans import reports
from lanternfish.plans.catalog import QUERIES
from lanternfish.streaming import events as growth
from lanternfish.streaming.keyed_log import KeyedLog


def test_event_rules(spark):
    rows = [
        ('{"event_name": "share_clicked", "location_name": " Hill ", "share_method": "copy"}',),
        ('{"event_name": "share_clicked", "location_name": "Hill", "share_method": "fax"}',),
        ('{"event_name": "share_clicked", "location_name": "Hill"}',),
        ('{"event_name": "shared_location_view", "location_name": "Hill", "share_method": "fax"}',),
        ('{"event_name": "other", "location_name": "Hill"}',),
        ('{"event_name": "shared_location_view", "location_name": "  "}',),
        ("no json",),
    ]
    df = spark.createDataFrame(rows, "payload string").withColumn("created_at", F.current_timestamp())
    got = sorted((r["event_name"], r["location_name"], r["share_method"] or "") for r in growth.valid_events(df).collect())
    assert got == [("share_clicked", "Hill", "copy"), ("shared_location_view", "Hill", "")]


def test_stream_equals_batch(spark):
    batch = growth.valid_events(reports.growth_events(spark, SMALL))
    streamed = QUERIES["stream_validate_events"](spark, SMALL)
    assert streamed.count() == batch.count()


def test_recent_counts_of_stream_and_table(spark):
    from lanternfish.plans.registry import table

    events = table(spark, SMALL, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    batch = growth.recent_counts(growth.day_counts(events, "ts", ["event_type"]), [7, 14, 30], ["event_type"])
    streamed = QUERIES["stream_recent_counts"](spark, SMALL)
    rows = lambda df: sorted((r["days"], r["until"], r["event_type"], r["reports"]) for r in df.collect())
    assert rows(batch) == rows(streamed)


def test_late_rows_change_open_days_and_replays_nothing(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "days", "check"))
    land = lambda k, *at: spark.createDataFrame([(dt.datetime.fromisoformat(x), "a") for x in at], "ts timestamp, kind string").coalesce(1).write.parquet(f"{source}/f={k}")

    def seen():
        stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        counts = growth.day_counts(stream, "ts", ["kind"])
        query = growth.write_day_counts(counts, root, ["kind"], checkpoint)
        query.awaitTermination()
        batches = query.lastProgress["batchId"] + 1
        daily = growth.day_log(spark, root, counts, ["kind"]).before(batches)
        return {str(r["day"])[5:]: r["n"] for r in daily.collect()}

    land(0, "2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-02 11:00:00")
    assert seen() == {"01-01": 1, "01-02": 2}
    land(1, "2024-01-01 23:00:00", "2024-01-03 01:00:00")  # one is late, within two days
    assert seen() == {"01-01": 2, "01-02": 2, "01-03": 1}
    land(2, "2024-01-09 00:00:00")
    assert seen() == {"01-01": 2, "01-02": 2, "01-03": 1, "01-09": 1}
    land(3, "2024-01-02 00:00:00", "2024-01-09 02:00:00")  # too late for its day
    assert seen() == {"01-01": 2, "01-02": 2, "01-03": 1, "01-09": 2}


def test_keyed_log_against_a_dictionary(spark, tmp_path):
    """Rows of many batches, with replays, in folders that are merged and removed."""
    rng, want = random.Random(3), {}
    log = KeyedLog(spark, str(tmp_path / "log"), T._parse_datatype_string("k int, a string, v int"), ["k"], fanout=2)
    assert log.before(0).count() == 0
    for n in range(9):
        rows = [(rng.randrange(6), rng.choice("xy"), rng.randrange(100)) for _ in range(4)]
        for _ in range(rng.randrange(1, 3)):
            log.write(spark.createDataFrame(rows, "k int, a string, v int"), n)
        for k in {r[0] for r in rows}:
            want[k] = max(r[1:] for r in rows if r[0] == k)
        assert {r["k"]: (r["a"], r["v"]) for r in log.before(n + 1).collect()} == want
    assert log.live(9) == [(3, 0), (0, 8)]
    some = spark.createDataFrame([(1,), (77,)], "k int")
    assert {r["k"] for r in log.before(9, some).collect()} == {1} & set(want)
    # a batch reads no folder that is older than the last merge
    read = log.before(9)._jdf.inputFiles()
    assert {f.split("/level=")[1].split("/")[0] for f in read} == {"3", "0"}
    assert not (tmp_path / "log" / "level=0" / "part=0").exists()


def test_ties_of_landings_are_declared(spark, tmp_path):
    from lanternfish.streaming import upsert

    record = ("2026", "1 Ann", "u1", "i", "p", "2026-05-05")
    landings = [("1", "u1", "a", 200, "", "", record), ("1", "u1", "a", 404, "", "", None), ("2", "u2", "a", 404, "", "", None), ("2", "u2", "b", 200, "", "", record)]
    upsert.apply_batch(spark.createDataFrame(landings, upsert.LANDED), 0, str(tmp_path), "t0")
    _, state = upsert.latest(spark, str(tmp_path), 1)
    assert {r["id"]: r["fetch_status"] for r in state.collect()} == {"1": "http_404", "2": "ok"}


def test_upsert_stream_keeps_earlier_batches(spark):
    got = QUERIES["stream_upsert"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_upsert_log_across_batches(spark, tmp_path):
    """A later failed fetch keeps the record; replaying a batch changes nothing."""
    from lanternfish.streaming import upsert

    record = ("2026", "1 Ann", "u1", "i", "p", "2026-05-05")
    first = spark.createDataFrame([("1", "u1", "a", 200, "", "", record), ("2", "u2", "a", 404, "", "", None)], upsert.LANDED)
    second = spark.createDataFrame([("1", "u1", "b", 404, "", "", None), ("3", "u3", "b", 200, "", "", record)], upsert.LANDED)
    root = str(tmp_path)
    upsert.apply_batch(first, 0, root, "t0")
    upsert.apply_batch(second, 1, root, "t1")
    upsert.apply_batch(second, 1, root, "t1")
    records, state = upsert.latest(spark, root, 2)
    assert sorted(r["id"] for r in records.collect()) == ["1", "3"]
    got = {r["id"]: (r["fetch_status"], r["first_seen_at"], r["last_seen_at"]) for r in state.collect()}
    assert got == {"1": ("http_404", "t0", "t1"), "2": ("http_404", "t0", "t0"), "3": ("ok", "t1", "t1")}


def test_a_batch_reads_nothing_old(spark, tmp_path):
    """The date an id was first seen comes together in the log, over merged folders too."""
    from lanternfish.streaming import upsert

    record = ("2026", "1 Ann", "u1", "i", "p", "2026-05-05")
    root = str(tmp_path)
    land = lambda *rows: spark.createDataFrame([(i, f"u{i}", "a", code, "", "", record if code == 200 else None) for i, code in rows], upsert.LANDED)
    upsert.apply_batch(land(("1", 200), ("2", 404), (None, 404)), 0, root, "t0")
    seen, before = [], upsert.KeyedLog.before
    try:
        upsert.KeyedLog.before = lambda log, number, *only: seen.append(before(log, number, *only)) or seen[-1]
        for n in range(1, 9):
            upsert.apply_batch(land((str(n % 3 + 1), 404), (None, 404)), n, root, f"t{n}")
    finally:
        upsert.KeyedLog.before = before
    assert not any(df._jdf.inputFiles() for df in seen)
    records, state = upsert.latest(spark, root, 9)
    assert [(r["id"], r["title"]) for r in records.collect()] == [("1", "1 Ann")]
    got = {r["id"]: (r["first_seen_at"], r["last_seen_at"]) for r in state.collect()}
    assert got == {"1": ("t0", "t6"), "2": ("t0", "t7"), "3": ("t2", "t8"), None: ("t8", "t8")}
