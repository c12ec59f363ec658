"""Incremental ingest as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..schema import RECORD, STATE
from ..session import cut_lineage
from .keyed_log import KeyedLog

# Fetched pages as they land: status and the extracted record (or why there is none).
LANDED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("sitemap_lastmod", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("rejection", T.StringType()),
        T.StructField("warning", T.StringType()),
        T.StructField("record", T.StructType([f for f in RECORD.fields if f.name != "id"])),
    ]
)


def logs(spark: SparkSession, root: str) -> tuple[KeyedLog, KeyedLog]:
    """Tables of records and of state."""
    return KeyedLog(spark, f"{root}/records", RECORD, ["id"]), KeyedLog(spark, f"{root}/state", STATE, ["id"], first=["first_seen_at"])


def apply_batch(batch: DataFrame, number: int, root: str, now: str) -> None:
    """Merge one micro-batch into the tables of records and state.

    Of several landings of an id the newest counts; of those with one date the greatest by status code, then by the other
    fields in their order. A landing is listed and fetched, so of what batches before this one have left only the date an id
    was first seen outlives it, and a failed fetch writes no record: the logs see to both when they are merged or read. A
    batch reads nothing old, its work doesn't grow with the tables, and replaying it after a failure gives the same tables.
    """
    fields = ["sitemap_lastmod", "status_code", "url", "rejection", "warning", "record"]
    # a file is read by one task: its rows are dealt first, so that many tasks look for the newest
    newest = batch.repartition("id").groupBy("id").agg(F.max(F.struct(*fields)).alias("f"))
    records, state = logs(batch.sparkSession, root)
    fetched = newest.select("id", "f.status_code", "f.rejection", "f.warning", "f.record")
    landed = newest.select("id", "f.url", "f.sitemap_lastmod")
    joined = cut_lineage(ingest.join_sources(landed, records.before(0), state.before(0), fetched))
    records.write(ingest.merge_upsert(joined.where(ingest.fetch_status() == "ok")), number, unique=True)
    state.write(ingest.next_state(joined, now), number, unique=True)


def stream_upsert(landing: DataFrame, root: str, checkpoint: str, now: str) -> StreamingQuery:
    return (
        landing.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, root, now))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, root: str, batches: int) -> tuple[DataFrame, DataFrame]:
    """Records and state after so many batches."""
    records, state = logs(spark, root)
    return records.before(batches), state.before(batches)
