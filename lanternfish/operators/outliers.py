"""Extreme-number outliers per group, without a loop and without an unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

# Size of the reference window, smallest ratio and gap of an outlier.
REFERENCE_WINDOW = 5
MIN_RATIO = 1.5
MIN_GAP = 500

# Numbers are looked at in value ranges of this width, so no task sees all numbers of a group.
RANGE_WIDTH = 4096


def distinct_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Distinct (group, number) pairs: hashed on both columns, so a hot group spreads out."""
    return rows.where(F.col(number).isNotNull()).select(group, number).distinct()


def flag_numbers(distinct: DataFrame, group: str, number: str) -> DataFrame:
    """Every distinct number of each group with the outlier flag.

    Repeatedly popping the top value while it is extreme against the median of the five below equals: everything above
    the highest value that is not extreme. The median of five sorted values is the third one. The values below come
    from the same range of values or, at its lower edge, from the highest five of the next ranges that hold any.
    """
    within = W.partitionBy(group, "range").orderBy(F.col(number).desc())
    ranked = distinct.select(group, number, F.floor(F.col(number) / RANGE_WIDTH).alias("range")).withColumn("place", F.row_number().over(within))
    tops = ranked.where(F.col("place") <= REFERENCE_WINDOW).groupBy(group, "range").agg(
        F.sort_array(F.collect_list(number), asc=False).alias("top")
    )
    downwards = W.partitionBy(group).orderBy(F.col("range").desc())
    none = F.array().cast(tops.schema["top"].dataType)
    following = F.flatten(F.array(*[F.coalesce(F.lead("top", k).over(downwards), none) for k in range(1, REFERENCE_WINDOW + 1)]))
    carried = tops.withColumn("below", F.slice(following, 1, REFERENCE_WINDOW)).drop("top")
    left = F.count("*").over(W.partitionBy(group, "range")) - F.col("place")
    inside = ranked.withColumn("left", left)
    for k in (3, REFERENCE_WINDOW):
        inside = inside.withColumn(f"lower_{k}", F.lead(number, k).over(within))
    placed = inside.join(carried, [group, "range"])
    lower = lambda k: F.coalesce(f"lower_{k}", F.get("below", (k - 1 - F.col("left")).cast("int")))
    extreme = (
        lower(REFERENCE_WINDOW).isNotNull()
        & (F.col(number) >= lower(3) * MIN_RATIO)
        & (F.col(number) - lower(3) >= MIN_GAP)
    )
    flagged = placed.select(group, number, F.coalesce(extreme, F.lit(False)).alias("extreme"))
    clean = flagged.where(~F.col("extreme")).groupBy(group).agg(F.max(number).alias("highest_clean"))
    return flagged.join(clean, group).select(group, number, (F.col(number) > F.col("highest_clean")).alias("is_outlier"))


def outlier_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number) pairs that are extreme."""
    distinct = distinct_numbers(rows, group, number)
    return flag_numbers(distinct, group, number).where("is_outlier").select(group, number)


def mark_outliers(rows: DataFrame, group: str, number: str, name: str = "is_outlier", among: DataFrame | None = None) -> DataFrame:
    """All rows plus the outlier flag; ``among``: a smaller table with the same groups and numbers.

    The pairs are written out first: their file size (normally a few rows) lets the optimizer
    broadcast them, and the wide rows are not shuffled.
    """
    found = outlier_numbers(rows if among is None else among, group, number)
    outliers = cut_lineage(found).withColumn(name, F.lit(True))
    return rows.join(outliers, [group, number], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def drop_outliers(rows: DataFrame, group: str, number: str) -> DataFrame:
    return rows.join(cut_lineage(outlier_numbers(rows, group, number)), [group, number], "left_anti")


def keep_outliers(rows: DataFrame, group: str, number: str) -> DataFrame:
    return rows.join(cut_lineage(outlier_numbers(rows, group, number)), [group, number], "left_semi")


def recovery_by_group(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Per group: distinct clean numbers, highest clean number, recovery rate, number of reports.

    One pre-aggregation by (group, number) is the only pass over the reports; it is written out
    because two branches need it. The outlier branch sees distinct numbers only.
    """
    per_number = cut_lineage(rows.groupBy(group, number).agg(F.count("*").alias("reports")))
    totals = per_number.groupBy(group).agg(
        F.count(number).alias("numbers"), F.sum("reports").cast("bigint").alias("report_count")
    )
    top = flag_numbers(per_number.where(F.col(number).isNotNull()), group, number)
    edges = top.groupBy(group).agg(
        F.count(F.when(F.col("is_outlier"), 1)).alias("outliers"),
        F.max(F.when(~F.col("is_outlier"), F.col(number))).alias("hidden"),
    )
    found = F.col("numbers") - F.coalesce("outliers", F.lit(0))
    hidden = F.coalesce("hidden", F.lit(0))
    return totals.join(edges, group, "left").select(
        group,
        found.alias("found"),
        hidden.alias("hidden"),
        F.when(hidden > 0, found / hidden * 100).otherwise(F.lit(0.0)).alias("recovery_rate"),
        "report_count",
    )
