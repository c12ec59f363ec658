"""Growth events: one validation shared by the batch count and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .keyed_log import KeyedLog

# Allowed event names and share methods.
SHARE_EVENT = "share_clicked"
ALLOWED_EVENTS = ("share_clicked", "shared_location_view")
ALLOWED_METHODS = ("native", "copy")

PAYLOAD = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("location_name", T.StringType()),
        T.StructField("share_method", T.StringType()),
    ]
)


def valid_events(raw: DataFrame, payload: str = "payload", created_at: str = "created_at") -> DataFrame:
    """JSON payloads -> accepted events; stateless, so it runs unchanged on a stream."""
    parsed = raw.select(F.from_json(payload, PAYLOAD).alias("p"), F.col(created_at).alias("created_at"))
    name, place = F.trim("p.event_name"), F.trim("p.location_name")
    method = F.trim("p.share_method")
    is_share = name == SHARE_EVENT
    keep = name.isin(*ALLOWED_EVENTS) & (place != "") & (~is_share | F.coalesce(method.isin(*ALLOWED_METHODS), F.lit(False)))
    return parsed.where(keep).select(
        name.alias("event_name"),
        place.alias("location_name"),
        F.when(is_share, method).alias("share_method"),
        "created_at",
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name", "location_name", F.coalesce("share_method", F.lit("")).alias("share_method")).agg(
        F.count("*").alias("events")
    )


def read_event_stream(spark: SparkSession, folder: str, schema: T.StructType, **options: str) -> DataFrame:
    """Files landing in a folder; ``maxFilesPerTrigger`` and friends go into ``options``."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def append_valid_events(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Validate and append; the checkpoint makes every accepted event land exactly once."""
    return (
        valid_events(raw)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


DAY_COUNT = "n"


def day_counts(events: DataFrame, time: str, keys: list[str], lateness: str = "2 days") -> DataFrame:
    """(day, keys, n). On a stream in update mode every trigger emits the days it has changed, open ones too, and the state
    holds the days that may still change within ``lateness``; on a table the same plan is a plain count."""
    daily = events.withWatermark(time, lateness).groupBy(F.window(time, "1 day").alias("w"), *keys)
    return daily.agg(F.count("*").alias(DAY_COUNT)).select(F.to_date("w.start").alias("day"), *keys, DAY_COUNT)


def day_log(spark: SparkSession, root: str, counts: DataFrame, keys: list[str]) -> KeyedLog:
    return KeyedLog(spark, root, counts.schema, ["day", *keys])


def write_day_counts(counts: DataFrame, root: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keep a table of day counts up to date; a replayed trigger writes the same rows again."""
    schema = counts.schema

    def sink(batch: DataFrame, number: int) -> None:
        KeyedLog(batch.sparkSession, root, schema, ["day", *keys]).write(batch, number)

    return counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_counts(daily: DataFrame, lengths: list[int], keys: list[str]) -> DataFrame:
    """(days, until, keys, reports): counts of the last ``days`` days before the day ``until``, for all lengths at once, from
    day counts. A day counts in as many windows as they are long; windows that aren't over yet are included."""
    ages = F.explode(F.sequence(F.lit(1), F.lit(max(lengths)))).alias("age")
    aged = daily.select("day", *keys, DAY_COUNT, ages)
    windows = F.explode(F.filter(F.array(*[F.lit(d) for d in sorted(lengths)]), lambda d: d >= F.col("age"))).alias("days")
    spread = aged.select(F.date_add("day", F.col("age")).alias("until"), *keys, DAY_COUNT, windows)
    return spread.groupBy("days", F.col("until").cast("string").alias("until"), *keys).agg(F.sum(DAY_COUNT).alias("reports"))
