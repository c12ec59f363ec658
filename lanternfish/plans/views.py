"""Archive-shaped views over the given tables, as DataFrames and as SQL common table expressions.

An order is a report: numbered, found by a customer, at a spot (one per customer) and in a place
(the customer's nation), in a zone (its region), on a date. Embedding rows give spots coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

# Reports above this price carry an implausibly high number.
OUTLIER_PRICE = 499900.0


SPOT_WORDS = ("Beach", "Trail", "Market", "Stone")


def spot_name(key: Column) -> Column:
    word = F.get(F.array(*[F.lit(w) for w in SPOT_WORDS]), (key % len(SPOT_WORDS)).cast("int"))
    return F.concat(F.lit("Spot "), key.cast("string"), F.lit(" "), word)


def spot_word_sql(key: str) -> str:
    return f"({list(SPOT_WORDS)})[{key} % {len(SPOT_WORDS)} + 1]"


def finds_core(spark: SparkSession, folder: str) -> DataFrame:
    """Everything about a report that needs no join."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_custkey") % 3000 + 1 + F.when(F.col("o_totalprice") >= OUTLIER_PRICE, 9000).otherwise(0)).alias(
            "number"
        ),
        spot_name(F.col("o_custkey")).alias("spot"),
        F.col("o_orderdate").cast("date").alias("date_found"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("custkey"),
    )


FINDS_CORE = f"""finds_core as (
  select o_orderkey as id, cast(year(o_orderdate) as integer) as year,
         o_custkey % 3000 + 1 + case when o_totalprice >= {OUTLIER_PRICE} then 9000 else 0 end as number,
         'Spot ' || o_custkey || ' ' || {spot_word_sql('o_custkey')} as spot, cast(o_orderdate as date) as date_found,
         o_orderpriority as prio, o_orderstatus as status, o_custkey as custkey
  from orders)"""


def finds(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with finder, place and zone. The dimension joins are left to the optimizer's size check."""
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("finder"), "c_nationkey"
    )
    n = table(spark, folder, "nation")
    r = table(spark, folder, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"), F.col("r_name").alias("zone")
    )
    return finds_core(spark, folder).join(c, "custkey").join(places, "c_nationkey").drop("c_nationkey")


FINDS = FINDS_CORE + """,
finds as (
  select f.*, c_name as finder, n_name as place, r_name as zone
  from finds_core f join customer on c_custkey = f.custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""


def spots(spark: SparkSession, folder: str) -> DataFrame:
    """Spot dictionary: rounded coordinates (several spots share one) and exact ones."""
    e = table(spark, folder, "embeddings")
    exact = e.select(
        spot_name(F.col("vec_id")).alias("name"),
        (41 + F.col("embedding")[0].cast("double")).alias("exact_lat"),
        (-71 + F.col("embedding")[1].cast("double")).alias("exact_lon"),
        "label",
    )
    return exact.select(
        "name",
        F.round("exact_lat", 1).alias("lat"),
        F.round("exact_lon", 1).alias("lon"),
        "exact_lat",
        "exact_lon",
        "label",
    )


SPOTS = f"""spots as (
  select 'Spot ' || vec_id || ' ' || {spot_word_sql('vec_id')} as name,
         round(41 + cast(embedding[1] as double), 1) as lat, round(-71 + cast(embedding[2] as double), 1) as lon,
         41 + cast(embedding[1] as double) as exact_lat, -71 + cast(embedding[2] as double) as exact_lon, label
  from embeddings)"""


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as station readings: height at a time, of a kind."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("station"),
        F.col("ts"),
        F.col("value").alias("height"),
        F.col("event_type").alias("kind"),
        F.col("event_id"),
    )


READINGS = """readings as (
  select user_id as station, ts, value as height, event_type as kind, event_id from events)"""
