"""Recent activity for a whole table of target dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-back windows in days.
WINDOWS = (7, 14, 30)


def recent_activity(rows: DataFrame, date: str, targets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per target date (and key): reports of the last 7, 14 and 30 days; later reports never count.

    A target date without reports in 30 days has zeros; with keys, every key that has a report at all has a row on every date.

    Reports are counted per day first; each day count is then handed to the 31 dates it can
    matter for. No range join, and the work depends on days and keys, not on reports.
    """
    keys = keys or []
    daily = rows.where(F.col(date).isNotNull()).groupBy(date, *keys).agg(F.count("*").alias("n"))
    spread = daily.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(max(WINDOWS)))).alias("age"), date).select(
        *keys, "n", "age", F.date_add(date, F.col("age")).alias("target")
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("age") <= days, F.col("n"))), F.lit(0)).cast("bigint").alias(f"last_{days}")
        for days in WINDOWS
    ]
    asked = targets.select("target").where(F.col("target").isNotNull()).distinct()
    found = spread.join(asked, "target", "left_semi").groupBy("target", *keys).agg(*sums)
    if keys:
        # dates are few: they are handed to the keys as one array, so no key meets all others
        every = F.broadcast(asked.agg(F.collect_set("target").alias("targets")))
        known = daily.select(*keys).distinct().join(every).select(*keys, F.explode("targets").alias("target"))
        found = known.join(found, ["target", *keys], "left")
        counts = [F.coalesce(f"last_{days}", F.lit(0)).cast("bigint").alias(f"last_{days}") for days in WINDOWS]
        return found.select("target", *keys, *counts)
    counts = [F.coalesce(f"last_{days}", F.lit(0)).cast("bigint").alias(f"last_{days}") for days in WINDOWS]
    return asked.join(found, "target", "left").select("target", *counts)
