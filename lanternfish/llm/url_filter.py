"""URL filter with dated lists.

List entries say that a pattern was added to or removed from a list on a day. Each pattern's entries become validity
intervals, and a capture is blocked if a pattern of its URL was valid on the day it was fetched: an as-of join of
captures with intervals. Patterns are hosts (with all hosts below) and path prefixes; a URL has one key for each host
above it and each prefix of its path, so the join is by equality of keys. Intervals are cut into calendar months, which
bounds the intervals that meet a capture; months without a capture give no row. The capture side of a hot host is an ordinary side of a join and is split.

Defined cases: a null or odd URL or a null day matches nothing; several entries of one pattern on a day: the last one by
`seq` counts; an entry is valid from its day on, up to the day before the next entry of the pattern; repeated captures
get equal answers; empty captures or lists give empty results or no matches; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """`host:` keys of the host and all above it, `path:` keys of all prefixes of the path by segments."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("path:"), host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(host_of(url) != "", F.concat(hosts, prefixes)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to): intervals, end exclusive, from (pattern, action, dated_on, seq).

    Entries of a day are reduced to the last one before the days of a pattern are lined up.
    """
    daily = (
        entries.where("pattern is not null and dated_on is not null")
        .groupBy("pattern", "dated_on")
        .agg(F.max(F.struct("seq", "action")).alias("last"))
        .select("pattern", "dated_on", "last.action")
    )
    following = Window.partitionBy("pattern").orderBy("dated_on")
    return (
        daily.withColumn("valid_to", F.coalesce(F.lead("dated_on").over(following), F.lit(FOREVER).cast("date")))
        .where("action = 'add'")
        .select("pattern", F.col("dated_on").alias("valid_from"), "valid_to")
    )


def block(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (`url`, `fetched_on` and others) with `blocked` and `pattern`, the first that blocks in text order."""
    month = lambda c: F.trunc(c, "month")
    # one row with the months that have a capture, at most those of the calendar; others are of no use
    fetched = captures.agg(F.collect_set(month(F.col("fetched_on"))).alias("months"))
    spans = (
        validity(entries)
        .join(F.broadcast(fetched))
        .withColumn("month", F.explode(F.filter("months", lambda m: (m >= month(F.col("valid_from"))) & (m < F.col("valid_to")))))
        .select("pattern", "month", "valid_from", "valid_to")
    )
    rows = packed(captures).select("doc", F.col("doc.url").alias("u"), F.col("doc.fetched_on").alias("day"))
    # equal captures are asked once; the answers go back by URL and day
    asked = rows.where("u is not null and day is not null").select("u", "day").distinct()
    hits = (
        asked.withColumn("pattern", F.explode(F.array_distinct(keys_of(F.col("u")))))
        .withColumn("month", month("day"))
        .join(spans, ["pattern", "month"])
        .where("valid_from <= day and day < valid_to")
        .groupBy(F.col("u").alias("hit_u"), F.col("day").alias("hit_day"))
        .agg(F.min("pattern").alias("pattern"))
    )
    joined = rows.join(hits, (F.col("u") == F.col("hit_u")) & (F.col("day") == F.col("hit_day")), "left")
    return joined.select(*[F.col(f"doc.`{c}`") for c in captures.columns], F.col("pattern").isNotNull().alias("blocked"), "pattern")
