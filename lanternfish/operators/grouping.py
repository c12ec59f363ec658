"""Group sizes put back on rows, and bounded top-k per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


# Rows without a complete key match nothing; this many salts keep them from piling up in one task.
NULL_SALTS = 1024


def repeated_keys(rows: DataFrame, keys: list[str], name: str, counts: str | None = None) -> DataFrame:
    """Complete keys that occur more than once, with their number of rows; counted map-side first. ``counts``: column with
    the number of rows that a row stands for."""
    number = F.sum(counts) if counts else F.count("*")
    return rows.dropna(subset=keys).groupBy(*keys).agg(number.alias(name)).where(F.col(name) > 1)


def with_group_size(rows: DataFrame, keys: list[str], name: str, repeated: DataFrame | None = None) -> DataFrame:
    """Rows plus the size of their key group; rows with a null key get size 0.

    The count is pre-aggregated and joined back instead of ``count() over (partition by keys)``:
    a window would sort a whole hot group in one task, while an oversized partition of this join
    is split by adaptive execution (the counts hold each key once). Only repeated keys travel. They
    are written out first, so their true size decides: few of them are broadcast and the rows stay
    where they are, many of them are shuffled. A salt spreads rows whose key is incomplete.
    """
    if repeated is None:
        repeated = cut_lineage(repeated_keys(rows, keys, name))
    incomplete = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rest = [c for c in rows.columns if c not in keys] or keys
    salt = F.when(incomplete, F.pmod(F.xxhash64(*rest), F.lit(NULL_SALTS)) + 1).otherwise(F.lit(0))
    salted = rows.withColumn("_salt", salt.cast("bigint"))
    marked = repeated.withColumn("_salt", F.lit(0).cast("bigint"))
    joined = salted.join(marked, [*keys, "_salt"], "left")
    alone = F.when(F.col("_salt") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return joined.select(*rows.columns, F.coalesce(name, alone).alias(name))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle, so hot groups stay small."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def ranked_list(rows: DataFrame, keys: list[str], order: list[Column], value: Column, k: int, name: str) -> DataFrame:
    """Per group: comma-joined first k values in order; k bounds the collected array."""
    top = top_per_group(rows.withColumn("_v", value.cast("string")), keys, order, k, "_r")
    items = F.sort_array(F.collect_list(F.struct("_r", "_v")))
    return top.groupBy(*keys).agg(F.concat_ws(",", F.transform(items, lambda s: s["_v"])).alias(name))
