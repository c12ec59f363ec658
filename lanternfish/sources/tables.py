"""Scans, readers and writers of archive tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import url_record_id
from ..schema import DATABASE_OVERRIDES, OVERRIDE_FIELDS, RECORD


def scan(
    rows: DataFrame, columns: list[str], present: list[str] = (), year: int | None = None, date: str | None = None
) -> DataFrame:
    """Chosen columns, blanks dropped, optionally one year.

    The year becomes a half-open date range, so it reaches the parquet scan as a pushed filter;
    ``year(date) = n`` would not.
    """
    kept = rows
    if year is not None:
        low, high = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
        kept = kept.where((F.col(date) >= low) & (F.col(date) < high))
    for c in present:
        kept = kept.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return kept.select(*columns)


def scan_tolerant(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Required columns as text; absent ones come back blank."""
    known = set(rows.columns)
    return rows.select(
        *[F.col(c).cast("string").alias(c) if c in known else F.lit("").alias(c) for c in columns]
    )


def union_snapshots(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def sort_records(rows: DataFrame) -> DataFrame:
    """Newest year first, highest id first; texts that are no numbers sort as -1."""

    def number(c: str):
        return F.when(F.col(c).rlike(r"^\d+$"), F.col(c).try_cast("bigint")).otherwise(F.lit(-1))

    return rows.orderBy(number("year").desc(), number("id").desc())


# Ends a record, or an entry of an object of flat objects, in indented JSON. A line break can't stand inside a JSON string,
# so these three characters are never part of a value.
RECORD_END = "},\n"


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Indented JSON files in pieces of one record each; several tasks read one file. Other JSON comes as one piece."""
    pieces = spark.read.option("lineSep", RECORD_END).option("recursiveFileLookup", True).text(path)
    return pieces.select(F.btrim("value", F.lit(" \t\r\n")).alias("value")).where("value <> ''")


def read_records(spark: SparkSession, path: str | list[str], array_files: bool = True) -> DataFrame:
    """Record files: arrays of flat records, or JSON lines without ``array_files``. Either kind is split between tasks;
    arrays must be indented for that, a record or more on lines of their own."""
    if not array_files:
        return spark.read.schema(RECORD).json(path)
    # the first piece opens the array, the last one closes it; all others have lost the brace at their end
    ended = F.endswith("value", F.lit("}")) | F.endswith("value", F.lit("]")) | (F.col("value") == "[")
    closed = F.when(ended, F.col("value")).otherwise(F.concat("value", F.lit("}")))
    inner = F.regexp_replace(F.regexp_replace(closed, r"^\[", ""), r"\]$", "")
    parsed = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), T.ArrayType(RECORD))
    return _pieces(spark, path).select(F.explode(parsed).alias("r")).where("r is not null").select("r.*")


def read_records_or_snapshots(spark: SparkSession, path: str, snapshots: str | list[str]) -> DataFrame:
    """The canonical file, or all yearly snapshots when it holds nothing."""
    canonical = read_records(spark, path)
    return read_records(spark, snapshots) if canonical.isEmpty() else canonical


def write_arrays(rows: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Indented JSON arrays of about so many records a file, in the order of ids, newest first."""
    rows = rows.select(F.struct(*rows.columns).alias("r"))
    dealt = rows.withColumn("file", F.pmod(F.xxhash64("r.id"), F.lit(max(1, -(-rows.count() // per_file)))))
    lines = F.transform(F.sort_array(F.collect_list("r"), asc=False), lambda r: F.concat(F.lit("  {\n    "), F.regexp_extract(F.to_json(r), r"^\{(.*)\}$", 1), F.lit("\n  }")))
    texts = dealt.groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit("\n]")).alias("value"))
    texts.write.partitionBy("file").text(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON object each, id -> entry, one row per id: (id, fields map<string,string>, waivers array<string>).

    A JSON null counts as a present, blank value; entries that are no objects are dropped;
    a single waiver becomes a list. Indented files are split between tasks.
    """
    # all pieces but the first have lost the opening brace of the object, all but the last its closing one and their own
    opened = F.when(F.startswith("value", F.lit("{")), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value")))
    variant = F.coalesce(F.try_parse_json(opened), F.try_parse_json(F.concat(opened, F.lit("}}")))).alias("v")
    entries = _pieces(spark, path).select(variant).where("v is not null")
    opened_up = entries.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return overrides_of(opened_up.where("key is not null").select(F.col("key").alias("id"), F.to_json("value").alias("entry")))


def parse_overrides(text: DataFrame) -> DataFrame:
    """Override objects, one per text value, as rows."""
    return overrides_of(text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("id", "entry")))


def overrides_of(entries: DataFrame) -> DataFrame:
    """(id, entry): JSON text of an entry."""
    parsed = entries.where(F.trim("entry").startswith("{")).select(
        "id", F.from_json("entry", T.MapType(T.StringType(), T.StringType())).alias("m")
    )
    wanted = [*OVERRIDE_FIELDS, *DATABASE_OVERRIDES, "notes"]
    fields = F.transform_values(
        F.map_filter("m", lambda k, v: k.isin(*wanted)), lambda k, v: F.trim(F.coalesce(v, F.lit("")))
    )
    raw = F.coalesce(F.element_at("m", F.lit("validation_waivers")), F.lit(""))
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, T.ArrayType(T.StringType()))).otherwise(F.array(raw))
    waivers = F.filter(F.transform(listed, lambda w: F.trim(w)), lambda w: F.coalesce(w, F.lit("")) != "")
    return parsed.select("id", fields.alias("fields"), waivers.alias("waivers"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Yearly snapshots as written below; the year comes from the folder name."""
    return spark.read.schema(RECORD).json(path).select(*RECORD.names)


LISTING = T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType())])


def read_listing_xml(spark: SparkSession, path: str, pattern: str = r"/event/.+?/(\d+)/?$") -> DataFrame:
    """Source listing: one row per ``<url>`` whose path carries a record id, newest id first."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(LISTING).load(path)
    listed = rows.select(F.trim("loc").alias("url"), F.trim(F.coalesce("lastmod", F.lit(""))).alias("sitemap_lastmod"))
    keyed = listed.withColumn("id", url_record_id(F.col("url"), pattern)).where(F.col("id") != "")
    # an id listed twice counts once
    unique = keyed.groupBy("id").agg(F.max(F.struct("sitemap_lastmod", "url")).alias("e"))
    return unique.select("id", "e.url", "e.sitemap_lastmod").orderBy(F.col("id").try_cast("bigint").desc())


def write_table(rows: DataFrame, path: str) -> None:
    """Replace a table."""
    rows.write.mode("overwrite").parquet(path)


def write_snapshots(rows: DataFrame, path: str) -> None:
    """JSON snapshots, one folder per year, each file sorted by id (newest first)."""
    rows.sortWithinPartitions(F.col("year").desc(), F.col("id").try_cast("bigint").desc()).write.mode(
        "overwrite"
    ).partitionBy("year").json(path)


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Replace exactly the rows of one run: writing the same run twice changes nothing."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def write_report(flagged: DataFrame, json_path: str, csv_path: str) -> None:
    """Flagged rows as JSON (arrays kept) and as CSV (arrays comma-joined)."""
    flagged.write.mode("overwrite").json(json_path)
    arrays = [f.name for f in flagged.schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = flagged.select(*[F.concat_ws(",", c).alias(c) if c in arrays else F.col(c) for c in flagged.columns])
    flat.write.mode("overwrite").option("header", True).csv(csv_path)
