"""Set comparisons and output checks; every check is a DataFrame of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Keys that a task of the checks compares: ids compress so well that a shuffled partition of the usual size holds millions.
KEYS_PER_TASK = 250_000


def dealt(rows: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """The keys, dealt to that many tasks; without a number it is left to Spark, which counts compressed bytes only."""
    return rows.select(*keys).repartition(tasks, *keys) if tasks else rows.select(*keys)


def reconcile_ids(
    left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("left", "right"), tasks: int | None = None
) -> DataFrame:
    """Keys that only one of two stores has, with the side that has them."""
    a = dealt(left, keys, tasks).distinct().withColumn("_a", F.lit(True))
    b = dealt(right, keys, tasks).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("_b").isNull(), F.lit(names[0])).when(F.col("_a").isNull(), F.lit(names[1]))
    return both.select(*keys, side.alias("only_in")).where("only_in is not null")


def missing_keys(required: DataFrame, known: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    return dealt(required, [key], tasks).distinct().join(dealt(known, [key], tasks), key, "left_anti")


def missing_fields(expected: list[str], fields: Column) -> Column:
    """Expected map keys that are absent."""
    return F.array_except(F.array(*[F.lit(e) for e in expected]), F.map_keys(fields))


def key_coverage(rows: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """Values of a fixed spine that are missing, and values outside of it."""
    spine = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("key"))
    present = rows.select(F.col(column).cast("int").alias("key")).distinct()
    missing = spine.join(present, "key", "left_anti").withColumn("problem", F.lit("missing"))
    extra = present.join(spine, "key", "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def duplicate_ids(rows: DataFrame, key: str = "id", tasks: int | None = None) -> DataFrame:
    repeated = dealt(rows, [key], tasks).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return finding("duplicate_ids", repeated, F.col(key).cast("string"))


def finding(check: str, rows: DataFrame, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), detail.alias("detail"))


def all_findings(findings: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings)


def output_checks(
    records: DataFrame,
    table: DataFrame,
    manifest: DataFrame,
    snapshots: DataFrame,
    state: DataFrame,
    days: DataFrame,
    months: DataFrame,
) -> DataFrame:
    """All consistency checks of one build as (check, detail) rows; no rows means: all is well.

    ``records``: id, year, date_found. ``table``: id. ``manifest``: total_records, latest_source_date.
    ``snapshots``: id, year. ``state``: id, fields (map). ``days``/``months``: the keys of the artifact.
    """
    facts = cut_lineage(
        records.agg(F.count("*").alias("records"), F.coalesce(F.max(F.nullif("date_found", F.lit(""))), F.lit("")).alias("latest"))
    )
    tasks = facts.first()["records"] // KEYS_PER_TASK + 1
    joined = manifest.join(F.broadcast(facts))
    drift = reconcile_ids(records, table, ["id"], ("records", "table"), tasks)
    snapshot_drift = reconcile_ids(records, snapshots, ["id", "year"], ("records", "snapshots"), tasks)
    absent = state.select("id", F.explode(missing_fields(["url", "fetch_status"], F.col("fields"))).alias("field"))
    return all_findings(
        [
            duplicate_ids(records, tasks=tasks),
            finding("id_drift", drift, F.concat_ws(":", "only_in", F.col("id").cast("string"))),
            finding(
                "manifest_total", joined.where("total_records <> records"), F.concat_ws(":", "total_records", "records")
            ),
            finding(
                "manifest_latest_date",
                joined.where("latest_source_date <> latest"),
                F.concat_ws(":", "latest_source_date", "latest"),
            ),
            finding(
                "snapshot_drift",
                snapshot_drift,
                F.concat_ws(":", "only_in", F.col("year").cast("string"), F.col("id").cast("string")),
            ),
            finding("state_missing_id", missing_keys(records, state, "id", tasks), F.col("id").cast("string")),
            finding("state_missing_field", absent, F.concat_ws(":", F.col("id").cast("string"), "field")),
            finding(
                "artifact_days",
                key_coverage(days, "day", 1, 366),
                F.concat_ws(":", "problem", F.col("key").cast("string")),
            ),
            finding(
                "artifact_months",
                key_coverage(months, "month", 1, 12),
                F.concat_ws(":", "problem", F.col("key").cast("string")),
            ),
        ]
    )
