"""Scans, filters, search, joins, aggregates, top-k and set queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, rules
from ..operators import archive, checks, grouping, labels, nearest, outliers, recency, series, zones
from ..session import cut_lineage
from ..sources import tables
from ..streaming import events as growth
from . import scalars, views
from .registry import query, table

# ---------------------------------------------------------------- scans


@query(
    "scan_project_filter",
    """select o_orderkey as id, o_orderpriority as prio, o_totalprice as price from orders
       where year(o_orderdate) = 1998 and o_orderpriority is not null and o_orderpriority <> ''""",
)
def scan_project_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.scan(
        table(spark, folder, "orders"),
        ["o_orderkey", "o_orderpriority", "o_totalprice"],
        present=["o_orderpriority"],
        year=1998,
        date="o_orderdate",
    )
    return rows.toDF("id", "prio", "price")


@query(
    "scan_tolerant",
    """select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
        '' as image_url, '' as source from customer""",
)
def scan_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ["c_custkey", "c_name", "c_nationkey", "image_url", "source"]
    return tables.scan_tolerant(table(spark, folder, "customer"), wanted)


# ---------------------------------------------------------------- filters and search


@query("year_filter", f"with {views.FINDS_CORE} select year, count(*) as reports from finds_core where year = 1997 group by year")
def year_filter(spark: SparkSession, folder: str) -> DataFrame:
    f = archive.year_filter(views.finds_core(spark, folder), "1997")
    return f.groupBy("year").agg(F.count("*").alias("reports"))


SEARCH_FIELDS = ["finder", "place", "number", "prio", "zone"]
SEARCH_ORDER = ["year", "date_found", "id"]


def search_order():
    return [F.col(c).desc() for c in SEARCH_ORDER]


def place_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The place dictionary: a rule per nation, in the order of their numbers."""
    n = table(spark, folder, "nation")
    return n.select(F.col("n_nationkey").alias("rule_order"), F.lower("n_name").alias("pattern"), F.col("n_name").alias("label"))


def searches(spark: SparkSession, folder: str) -> DataFrame:
    """Search texts: names of places and zones, numbers with and without a sign, priorities."""
    n, r, o = (table(spark, folder, t) for t in ("nation", "region", "orders"))
    key = F.col("n_nationkey").cast("string")
    texts = [n.select(F.lower("n_name")), n.select(F.concat(F.lit("#"), key)), n.select(key), r.select(F.lower("r_name")), o.select("o_orderpriority")]
    return tables.union_snapshots([t.toDF("search") for t in texts]).distinct()


PLACE_LABEL = "(select n_name from nation where contains(lower({0}), lower(n_name)) order by n_nationkey limit 1)"


@query(
    "search_archive",
    f"""with {views.FINDS}, asked as (select distinct s, {PLACE_LABEL.format("s")} as asked_label from (
          select lower(n_name) as s from nation union all select '#' || n_nationkey from nation union all select n_nationkey::varchar from nation
          union all select lower(r_name) from region union all select o_orderpriority from orders)),
        named as (select place, {PLACE_LABEL.format("place")} as row_label from (select distinct place from finds)),
        hits as (select s as search, f.*, row_number() over (partition by s order by year desc, date_found desc, id desc) as rank
          from asked, finds f join named using (place)
          where contains(lower(finder), lower(s)) or contains(lower(place), lower(s)) or contains(number::varchar, lower(s))
             or contains(lower(prio), lower(s)) or contains(lower(zone), lower(s)) or contains(lower(coalesce(row_label, 'Other/Unknown')), lower(s))
             or (not contains(s, '#') and row_label = asked_label))
        select search, rank::integer as rank, id, year, cast(date_found as varchar) as date_found, place, finder from hits where rank <= 50""",
)
def search_archive(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.search(
        views.finds(spark, folder), searches(spark, folder), place_rules(spark, folder), SEARCH_FIELDS, "place", "id", SEARCH_ORDER
    )
    return found.select("search", "rank", "id", "year", F.col("date_found").cast("string").alias("date_found"), "place", "finder")


@query(
    "search_grouped",
    f"""with {views.FINDS}, hits as (select * from finds where contains(lower(prio), 'high')
           order by year desc, date_found desc, id desc limit 50),
        r as (select *, row_number() over (order by year desc, date_found desc, id desc) as rk from hits),
        f as (select place, finder, min(rk) as rk from r group by 1, 2),
        f3 as (select place, string_agg(finder, ',' order by rk) as recent_finders
               from (select *, row_number() over (partition by place order by rk) as k from f) where k <= 3 group by 1)
        select place as label, cast(min(rk) as integer) as first_rank, count(*) as reports, arg_min(id, rk) as latest_id,
               any_value(recent_finders) as recent_finders, string_agg(id, ',' order by rk) as report_ids
        from r join f3 using (place) group by place""",
)
def search_grouped(spark: SparkSession, folder: str) -> DataFrame:
    found = archive.search(views.finds(spark, folder), "high", "", SEARCH_FIELDS, "place", search_order())
    return archive.group_hits(found, "place", "finder", "id", search_order())


@query(
    "nonplaceholder_images",
    f"""with {scalars.RECORDS} select location as place, id, image, title, year, date_found from records
        where image <> '' and not contains(image, 'default_image') and trim(location) <> ''""",
)
def nonplaceholder_images(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import is_placeholder

    r = scalars.records(spark, folder)
    kept = r.where(archive.present("image") & ~is_placeholder(F.col("image")) & (F.trim("location") != ""))
    return kept.select(F.col("location").alias("place"), "id", "image", "title", "year", "date_found")


# ---------------------------------------------------------------- joins

SPOT_COUNTS = "spot_counts as (select spot, count(*) as reports from finds_core group by spot)"
MAPPED_PART = "mapped as (select spot as name, reports, lat, lon, exact_lat, exact_lon from spot_counts join spots on name = spot)"
MAPPED = f"{SPOT_COUNTS},\n{MAPPED_PART}"


def spot_counts(spark: SparkSession, folder: str) -> DataFrame:
    return archive.label_counts(views.finds_core(spark, folder), "spot")


def mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Reported spots of the dictionary: name, reports, lat, lon (rounded)."""
    joined = archive.mapped_spots(spot_counts(spark, folder), views.spots(spark, folder), "spot")
    return joined.withColumnRenamed("spot", "name")


@query("map_to_dimension", f"with {views.FINDS_CORE}, {views.SPOTS}, {MAPPED} select name, reports, lat, lon from mapped")
def map_to_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return mapped(spark, folder)


# every dictionary spot with its zone
MEMBER_PARTS = """all_spots as (select name, lat, lon, coalesce(reports, 0) as reports from spots left join spot_counts on spot = name),
zone_of as (select lat, lon, case when count(*) = 1 then first_name else first_name || ' area' end as zone
  from (select *, first_value(name) over (partition by lat, lon order by reports desc, name) as first_name from all_spots)
  group by lat, lon, first_name),
members as (select name, reports, lat, lon, zone,
  row_number() over (partition by zone order by reports desc, name) as member_rank
  from all_spots join zone_of using (lat, lon))"""
MEMBERS = f"{SPOT_COUNTS}, {MEMBER_PARTS}"


def members(spark: SparkSession, folder: str) -> DataFrame:
    return zones.zone_members(spot_counts(spark, folder), views.spots(spark, folder), "spot")


@query(
    "label_to_zone",
    f"""with {views.FINDS_CORE}, {views.SPOTS}, {MEMBERS} select id, spot, m.zone from finds_core join members m on m.name = spot""",
)
def label_to_zone(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder).select("id", "spot")
    return zones.label_to_zone(f, members(spark, folder), "spot").select("id", "spot", "zone")


@query(
    "legacy_rows",
    "select c_custkey as id, c_name as finder from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
)
def legacy_rows(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("finder"))
    canonical = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return stored.join(canonical, "id", "left_anti")


OUTLIERS = """dn as (select distinct year, number from finds_core),
ranked as (select *, row_number() over w as rn, lag(number, 3) over w as ref from dn window w as (partition by year order by number)),
flagged as (select *, coalesce(rn >= 6 and number >= 1.5 * ref and number - ref >= 500, false) as extreme from ranked),
outliers as (select year, number from (
   select *, max(case when not extreme then rn end) over (partition by year) as last_clean from flagged) where rn > last_clean)"""


@query(
    "extreme_number_split",
    f"""with {views.FINDS_CORE}, {OUTLIERS} select dn.year, dn.number, o.number is not null as is_outlier
        from dn left join outliers o on o.year = dn.year and o.number = dn.number""",
)
def extreme_number_split(spark: SparkSession, folder: str) -> DataFrame:
    distinct = outliers.distinct_numbers(views.finds_core(spark, folder), "year", "number")
    return outliers.mark_outliers(distinct, "year", "number")


@query(
    "outlier_rows",
    f"""with {views.FINDS_CORE}, {OUTLIERS} select id, year, number from finds_core where (year, number) in (select year, number from outliers)""",
)
def outlier_rows(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder).select("id", "year", "number")
    return outliers.keep_outliers(f, "year", "number").select("id", "year", "number")


@query(
    "reconcile_ids",
    """select id, year, only_in from (
         select coalesce(a.id, b.id) as id, coalesce(a.year, b.year) as year,
                case when b.id is null then 'reports' when a.id is null then 'lines' end as only_in
         from (select distinct o_orderkey as id, cast(year(o_orderdate) as integer) as year from orders) a
         full join (select distinct l_orderkey as id, cast(year(l_shipdate) as integer) as year from lineitem) b
         on a.id = b.id and a.year = b.year) where only_in is not null""",
)
def reconcile_ids(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    b = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.year("l_shipdate").alias("year"))
    return checks.reconcile_ids(a, b, ["id", "year"], ("reports", "lines"))


EXACT_SPOTS = "pts as (select name, reports, exact_lat as lat, exact_lon as lon from mapped)"


def exact_spots(spark: SparkSession, folder: str) -> DataFrame:
    places = views.spots(spark, folder).select("name", F.col("exact_lat").alias("lat"), F.col("exact_lon").alias("lon"))
    return archive.mapped_spots(spot_counts(spark, folder), places, "spot").withColumnRenamed("spot", "name")


PAIR_MILES = scalars.HAVERSINE_SQL.format(lat1="a.lat", lon1="a.lon", lat2="b.lat", lon2="b.lon")


@query(
    "nearest_k",
    f"""with {views.FINDS_CORE}, {views.SPOTS}, {MAPPED}, {EXACT_SPOTS},
        pairs as (select a.name, b.name as neighbor, b.reports as neighbor_reports, {PAIR_MILES} as exact
                  from pts a join pts b on a.name <> b.name),
        ranked as (select *, row_number() over (partition by name order by round(exact, 1), neighbor_reports desc, neighbor) as rank
                   from pairs)
        select name, neighbor, neighbor_reports, round(exact, 1) as miles,
          case when exact < 0.1 then 'Under 0.1 mi away' else printf('%.1f mi away', exact) end as distance_label,
          cast(rank as integer) as rank from ranked where rank <= 2""",
)
def nearest_k(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest_k(exact_spots(spark, folder), 2)


CLUSTERS = """clusters as (
  select lat, lon, cast(sum(reports) as bigint) as reports, count(*) as spot_count,
         case when count(*) = 1 then any_value(first_name) else any_value(first_name) || ' area' end as label,
         string_agg(case when rk <= 5 then name || ':' || reports end, ',' order by rk) as members,
         greatest(count(*) - 5, 0) as remaining_spots
  from (select *, row_number() over w as rk, first_value(name) over w as first_name
        from mapped window w as (partition by lat, lon order by reports desc, name)) group by lat, lon)"""
POINT_MILES = scalars.HAVERSINE_SQL.format(lat1="41.02", lon1="(-70.97)", lat2="lat", lon2="lon")


@query(
    "nearest_from_point",
    f"""with {views.FINDS_CORE}, {views.SPOTS}, {MAPPED}, {CLUSTERS}
        select label, reports, round({POINT_MILES}, 3) as miles from clusters order by {POINT_MILES}, label limit 5""",
)
def nearest_from_point(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest.nearest_from_point(archive.map_clusters(mapped(spark, folder)), 41.02, -70.97)
    return near.select("label", "reports", F.round("miles", 3).alias("miles"))


PROBES = """probes as (select distinct station, cast(ts as date) + interval 12 hour as probe_ts from readings)"""


def noon_probes(spark: SparkSession, folder: str) -> DataFrame:
    """One probe per station and day, at noon."""
    noon = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    return cut_lineage(views.readings(spark, folder).select("station", noon.alias("probe_ts")).distinct())


TIDE = f"""{PROBES},
nb as (select *, lag(ts) over w as prev_ts, lag(height) over w as prev_height, lead(ts) over w as next_ts,
              lead(height) over w as next_height from readings window w as (partition by station order by ts, event_id)),
inwin as (select p.station, p.probe_ts, n.* exclude (station) from probes p join nb n on n.station = p.station
          and n.ts between p.probe_ts - interval 12 hour and p.probe_ts + interval 18 hour),
spread as (select station, probe_ts, round(max(height) - min(height), 2) as daily_range from inwin group by all),
near as (select *, row_number() over (partition by station, probe_ts order by
           abs(epoch_us(ts) - epoch_us(probe_ts)), ts, event_id) as rk from inwin),
tide as (select station, probe_ts, round(height, 2) as height_now,
        case when coalesce(case when next_ts <= probe_ts + interval 18 hour then next_height end, height)
               >= coalesce(case when prev_ts >= probe_ts - interval 12 hour then prev_height end, height)
             then 'rising' else 'falling' end as stage, daily_range
        from near join spread using (station, probe_ts) where rk = 1)"""


@query(
    "nearest_in_time",
    f"""with {views.READINGS}, {TIDE} select station, strftime(probe_ts, '%Y-%m-%d') as day, height_now, stage, daily_range from tide""",
)
def nearest_in_time(spark: SparkSession, folder: str) -> DataFrame:
    context = series.tide_context(noon_probes(spark, folder), views.readings(spark, folder))
    return context.select(
        "station", F.date_format("probe_ts", "yyyy-MM-dd").alias("day"), "height_now", "stage", "daily_range"
    )


@query(
    "nearest_extreme_event",
    f"""with {views.READINGS}, {PROBES},
        near as (select p.station, p.probe_ts, r.kind, r.height, r.ts, row_number() over (partition by p.station, p.probe_ts
                   order by abs(epoch_us(r.ts) - epoch_us(p.probe_ts)), r.ts, r.event_id) as rk
                 from probes p join readings r on r.station = p.station and r.kind in ('purchase', 'error')
                  and r.ts between p.probe_ts - interval 12 hour and p.probe_ts + interval 18 hour)
        select station, strftime(probe_ts, '%Y-%m-%d') as day, case when kind = 'purchase' then 'high' else 'low' end as type,
               height, round((epoch_us(ts) - epoch_us(probe_ts)) / 3600000000.0, 1) + 0.0 as hours_away
        from near where rk = 1""",
)
def nearest_extreme_event(spark: SparkSession, folder: str) -> DataFrame:
    extremes = views.readings(spark, folder).where(F.col("kind").isin("purchase", "error"))
    near = series.nearest_reading(noon_probes(spark, folder), extremes, ["kind", "height"]).where("found is not null")
    micros = F.timestamp_diff("MICROSECOND", F.col("probe_ts"), F.col("found.ts"))
    return near.select(
        "station",
        F.date_format("probe_ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("found.kind") == "purchase", "high").otherwise("low").alias("type"),
        F.col("found.height").alias("height"),
        (F.round(micros / 3600000000.0, 1) + 0.0).alias("hours_away"),
    )


@query(
    "preferred_else_first",
    """select strftime(ts, '%Y-%m-%d %H') as hour, coalesce(max(case when user_id = 42 then user_id end), arg_min(user_id, event_id), 0)
        as user_id from events group by 1""",
)
def preferred_else_first(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return series.preferred_else_first(e, "hour", "user_id", "event_id", 42, 0)


@query(
    "trend_stage",
    f"""with {views.READINGS} select event_id, case when coalesce(lead(height) over w, height) >= coalesce(lag(height) over w, height)
        then 'rising' else 'falling' end as stage from readings window w as (partition by station order by ts, event_id)""",
)
def trend_stage(spark: SparkSession, folder: str) -> DataFrame:
    n = series.with_neighbors(views.readings(spark, folder))
    return n.select(
        "event_id", series.stage(F.col("prev_height"), F.col("next_height"), F.col("height")).alias("stage")
    )


# ---------------------------------------------------------------- aggregates


@query("count_by_label", f"with {views.FINDS} select place, count(*) as reports from finds group by place")
def count_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return archive.label_counts(views.finds(spark, folder), "place")


RECOVERY = f"""{OUTLIERS},
recovery as (
  select year, count(distinct case when o_number is null then number end) as found,
         coalesce(max(case when o_number is null then number end), 0) as hidden, count(*) as report_count
  from (select f.*, o.number as o_number from finds_core f left join outliers o on o.year = f.year and o.number = f.number)
  group by year)"""


@query(
    "recovery_by_year",
    f"""with {views.FINDS_CORE}, {RECOVERY} select year, found, hidden,
        round(case when hidden > 0 then found / hidden * 100 else 0.0 end, 4) as recovery_rate, report_count from recovery""",
)
def recovery_by_year(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder).select("year", "number")
    stats = outliers.recovery_by_group(f, "year", "number")
    return stats.withColumn("recovery_rate", F.round("recovery_rate", 4)).orderBy(F.col("year").desc())


@query(
    "unreported",
    f"""with {views.FINDS_CORE}, {RECOVERY} select cast(year as varchar) as season, hidden, found, hidden - found as unreported
        from recovery union all select 'all', cast(sum(hidden) as bigint), cast(sum(found) as bigint),
        cast(greatest(sum(hidden) - sum(found), 0) as bigint) from recovery""",
)
def unreported(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder).select("year", "number")
    stats = outliers.recovery_by_group(f, "year", "number")
    # one pass: the two-level grouping is a rollup over a handful of years
    total = stats.rollup("year").agg(F.sum("hidden").alias("hidden"), F.sum("found").alias("found"))
    gap = F.col("hidden") - F.col("found")
    return total.select(
        F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("season"),
        "hidden",
        "found",
        F.when(F.col("year").isNull(), F.greatest(gap, F.lit(0))).otherwise(gap).alias("unreported"),
    )


@query(
    "best_months",
    f"""with {scalars.DATE_PARTS}, m as (select monthname(d) as month, count(*) as reports from d where k not in (5, 9) group by 1)
        select month, reports, cast(sum(reports) over () as bigint) as total from m""",
)
def best_months(spark: SparkSession, folder: str) -> DataFrame:
    month = dates.month_of_text(F.col("raw"))
    counts = (
        scalars.date_texts(spark, folder)
        .select(month.alias("m"))
        .where("m is not null")
        .groupBy("m")
        .agg(F.count("*").alias("reports"))
    )
    total = counts.agg(F.sum("reports").alias("total"))
    named = counts.join(F.broadcast(total)).orderBy(F.col("reports").desc(), "m")
    return named.select(
        F.date_format(F.make_date(F.lit(2000), F.col("m"), F.lit(1)), "MMMM").alias("month"), "reports", "total"
    )


@query(
    "profile_counts",
    f"""with {scalars.RECORDS} select count(*) as total, count(nullif(date_found, '')) as dated,
        min(nullif(date_found, '')) as first_date, max(nullif(date_found, '')) as last_date from records""",
)
def profile_counts(spark: SparkSession, folder: str) -> DataFrame:
    dated = F.nullif(F.col("date_found"), F.lit(""))
    return scalars.records(spark, folder).agg(
        F.count("*").alias("total"),
        F.count(dated).alias("dated"),
        F.min(dated).alias("first_date"),
        F.max(dated).alias("last_date"),
    )


@query(
    "manifest_counts",
    f"""with {scalars.RECORDS} select year, count(*) as records, count(*) filter (date_found = '') as missing_dates,
        count(*) filter (url = '') as missing_urls, count(*) filter (image = '') as missing_images,
        coalesce(max(nullif(date_found, '')), '') as latest_source_date from records group by year""",
)
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    def blanks(c: str):
        return F.count(F.when(F.col(c) == "", 1))

    return (
        scalars.records(spark, folder)
        .groupBy("year")
        .agg(
            F.count("*").alias("records"),
            blanks("date_found").alias("missing_dates"),
            blanks("url").alias("missing_urls"),
            blanks("image").alias("missing_images"),
            F.coalesce(F.max(F.nullif(F.col("date_found"), F.lit(""))), F.lit("")).alias("latest_source_date"),
        )
    )


@query(
    "cleanup_by_year",
    f"""with {scalars.RECORDS} select year, count(*) as total, count(*) filter (date_found = '') as missing_dates,
        count(*) filter (image = '') as blank_images, count(*) filter (contains(image, 'default_image')) as placeholder_images,
        count(*) filter (trim(location) = '') as blank_locations from records group by year""",
)
def cleanup_by_year(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import is_placeholder

    return (
        scalars.records(spark, folder)
        .groupBy("year")
        .agg(
            F.count("*").alias("total"),
            F.count(F.when(F.col("date_found") == "", 1)).alias("missing_dates"),
            F.count(F.when(F.col("image") == "", 1)).alias("blank_images"),
            F.count(F.when(is_placeholder(F.col("image")), 1)).alias("placeholder_images"),
            F.count(F.when(F.trim("location") == "", 1)).alias("blank_locations"),
        )
    )


NATION_RULES = (("nation_1", "First Shore"), ("nation_2", "Second Shore"), ("nation_5", "Fifth Shore"))


@query(
    "top_unlabelled_places",
    f"""with {scalars.RECORDS} select location, count(*) as reports from records
        where trim(location) <> '' and not regexp_matches(lower(location), 'nation_1|nation_2|nation_5')
        group by location order by reports desc, location limit 50""",
)
def top_unlabelled_places(spark: SparkSession, folder: str) -> DataFrame:
    # distinct raw texts are labelled, not rows
    counts = scalars.records(spark, folder).where(F.trim("location") != "").groupBy("location").agg(F.count("*").alias("reports"))
    unknown = counts.where(rules.place_label(F.col("location"), NATION_RULES) == "Other/Unknown")
    return unknown.orderBy(F.col("reports").desc(), "location").limit(50)


@query(
    "map_clusters",
    f"with {views.FINDS_CORE}, {views.SPOTS}, {MAPPED}, {CLUSTERS} select * from clusters",
)
def map_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return archive.map_clusters(mapped(spark, folder))


@query(
    "heat_weight",
    f"""with {views.FINDS_CORE}, {views.SPOTS}, {MAPPED}, {CLUSTERS} select label, reports,
        round(greatest(sqrt(reports / (select max(reports) from clusters)), 0.18), 6) as weight from clusters""",
)
def heat_weight(spark: SparkSession, folder: str) -> DataFrame:
    return archive.heat_weights(archive.map_clusters(mapped(spark, folder))).withColumn("weight", F.round("weight", 6))


TAGS_SQL = """case when not (w or t or o) then 'mixed' else concat_ws(',', case when w then 'waterfront' end,
          case when t then 'trail' end, case when o then 'town' end) end"""
ZONE_DEFS = f"""zone_defs as (
  select zone, lat, lon, support_count, spot_count, spots, {TAGS_SQL} as tags from (
    select zone, lat, lon, cast(sum(reports) as bigint) as support_count, count(*) as spot_count,
         string_agg(case when member_rank <= 5 then name end, ',' order by member_rank) as spots,
         bool_or(regexp_matches(lower(name), '{"|".join(rules.WATERFRONT)}')) as w,
         bool_or(regexp_matches(lower(name), '{"|".join(rules.TRAIL)}')) as t,
         bool_or(regexp_matches(lower(name), '{"|".join(rules.TOWN)}')) as o
    from members group by zone, lat, lon))"""


@query("zone_definitions", f"with {views.FINDS_CORE}, {views.SPOTS}, {MEMBERS}, {ZONE_DEFS} select * from zone_defs")
def zone_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return zones.zone_definitions(members(spark, folder)).withColumn("tags", F.concat_ws(",", "tags"))


@query(
    "place_detail",
    f"""with {views.FINDS},
        y as (select place, year, count(*) as n from finds group by all),
        py as (select place, cast(sum(n) as bigint) as reports, count(*) as years_tracked, max(n) as peak_reports,
                 arg_max(year, n * 10000 + year) as peak_year from y group by place),
        r as (select *, row_number() over (partition by place order by year desc, date_found desc, id desc) as rk from finds),
        fs as (select place, finder, count(*) as n, min(rk) as rk from r group by all),
        tf as (select place, finder as top_finder, n as top_finder_reports from (
                 select *, row_number() over (partition by place order by n desc, rk) as k from fs) where k = 1)
        select py.*, top_finder, top_finder_reports, r.id as latest_id from py join tf using (place) join r using (place) where rk = 1""",
)
def place_detail(spark: SparkSession, folder: str) -> DataFrame:
    return archive.place_summary(views.finds(spark, folder), "place", "finder", "date_found", "id")


@query(
    "place_recent_rows",
    f"""with {views.FINDS} select place, id, row_number() over (partition by place order by year desc, date_found desc, id desc) <= 18
        as recent from finds""",
)
def place_recent_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.finds(spark, folder).select("place", "id", "year", "date_found")
    return archive.split_recent(rows, ["place"], search_order(), "id", archive.RECENT_ROWS, "recent").select(
        "place", "id", "recent"
    )


@query(
    "place_image_pages",
    f"""with {scalars.RECORDS} select location as place, id, row_number() over (partition by location
          order by year desc, date_found desc, cast(id as bigint) desc) <= 12 as featured from records
        where image <> '' and not contains(image, 'default_image') and trim(location) <> ''""",
)
def place_image_pages(spark: SparkSession, folder: str) -> DataFrame:
    images = nonplaceholder_images(spark, folder)
    order = [F.col("year").desc(), F.col("date_found").desc(), F.col("id").cast("bigint").desc()]
    return archive.split_recent(images, ["place"], order, "id", archive.IMAGE_PAGE, "featured").select(
        "place", "id", "featured"
    )


@query(
    "archive_signal",
    f"""with {views.FINDS_CORE} select spot, count(*) as reports, count(distinct year) as years,
        case when count(*) >= 12 or count(distinct year) >= 5 then 'strong archive signal'
             when count(*) >= 4 or count(distinct year) >= 2 then 'steady archive signal' else 'light archive signal' end as signal
        from finds_core group by spot""",
)
def archive_signal(spark: SparkSession, folder: str) -> DataFrame:
    years = views.finds_core(spark, folder).groupBy("spot", "year").agg(F.count("*").alias("n"))
    per_spot = years.groupBy("spot").agg(F.sum("n").alias("reports"), F.count("*").alias("years"))
    return per_spot.withColumn("signal", archive.archive_signal(F.col("reports"), F.col("years")))


RECENCY_SUMS = """cast(count(*) filter (t.target - f.date_found <= 7) as bigint) as last_7,
          cast(count(*) filter (t.target - f.date_found <= 14) as bigint) as last_14, count(f.date_found) as last_30"""


@query(
    "recent_activity",
    f"""with {views.FINDS_CORE}, t as (
            select unnest(range(min(date_found)::timestamp, max(date_found)::timestamp + interval 61 day, interval 1 day))::date as target
            from finds_core)
        select cast(t.target as varchar) as target, {RECENCY_SUMS}
        from t left join finds_core f on f.date_found between t.target - 30 and t.target group by 1""",
)
def recent_activity(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder).select("date_found")
    # every day from the first report to 60 days after the last one, with or without reports
    days = f.agg(F.min("date_found").alias("a"), F.date_add(F.max("date_found"), 60).alias("b"))
    recent = recency.recent_activity(f, "date_found", days.select(F.explode(F.sequence("a", "b")).alias("target")))
    return recent.withColumn("target", F.col("target").cast("string"))


@query(
    "recent_activity_by_zone",
    f"""with {views.FINDS}, t as (select distinct date_found as target from finds)
        select cast(t.target as varchar) as target, z.zone, {RECENCY_SUMS}
        from t cross join (select distinct zone from finds) z
        left join finds f on f.zone = z.zone and f.date_found between t.target - 30 and t.target group by 1, 2""",
)
def recent_activity_by_zone(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds(spark, folder).select("date_found", "zone")
    recent = recency.recent_activity(f, "date_found", f.select(F.col("date_found").alias("target")), ["zone"])
    return recent.withColumn("target", F.col("target").cast("string"))


@query(
    "distinct_years",
    f"""with {views.FINDS} select zone, string_agg(distinct year::varchar, ',' order by year::varchar) as years from finds group by zone""",
)
def distinct_years(spark: SparkSession, folder: str) -> DataFrame:
    pairs = views.finds(spark, folder).select("zone", "year").distinct()
    years = F.transform(F.sort_array(F.collect_set("year")), lambda y: y.cast("string"))
    return pairs.groupBy("zone").agg(F.concat_ws(",", years).alias("years"))


def growth_events(spark: SparkSession, folder: str) -> DataFrame:
    """Test events as JSON payloads of the growth log, invalid ones included."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int") % 3
    payload = F.to_json(
        F.struct(
            F.when(kind == "click", "share_clicked").when(kind == "view", "shared_location_view").otherwise(kind).alias("event_name"),
            F.when(F.col("value") < 2, " ").otherwise(F.concat(F.lit(" Spot "), F.col("user_id"))).alias("location_name"),
            F.when(k == 0, "native").when(k == 1, " copy ").otherwise("fax").alias("share_method"),
        )
    )
    return table(spark, folder, "events").select(payload.alias("payload"), F.col("ts").alias("created_at"))


@query(
    "event_counts",
    """with e as (select case event_type when 'click' then 'share_clicked' when 'view' then 'shared_location_view' end as event_name,
            case when value < 2 then '' else 'Spot ' || user_id end as location_name,
            case (json_extract_string(props, '$.k')::integer) % 3 when 0 then 'native' when 1 then 'copy' else 'fax' end as m from events)
       select event_name, location_name, case when event_name = 'share_clicked' then m else '' end as share_method, count(*) as events
       from e where event_name is not null and location_name <> '' and (event_name <> 'share_clicked' or m <> 'fax') group by all""",
)
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return growth.event_counts(growth.valid_events(growth_events(spark, folder)))


# ---------------------------------------------------------------- order and top-k


@query(
    "sort_records",
    f"""with {scalars.RECORDS} select case when date_found = '' then 'unknown' else year end as year, id from records""",
)
def sort_records(spark: SparkSession, folder: str) -> DataFrame:
    r = scalars.records(spark, folder).select(
        F.when(F.col("date_found") == "", "unknown").otherwise(F.col("year")).alias("year"), "id"
    )
    return tables.sort_records(r)


@query(
    "top_places",
    f"with {views.FINDS_CORE}, {views.SPOTS}, {MAPPED} select name, reports from mapped order by reports desc, name limit 20",
)
def top_places(spark: SparkSession, folder: str) -> DataFrame:
    return mapped(spark, folder).select("name", "reports").orderBy(F.col("reports").desc(), "name").limit(archive.TOP_PLACES)


@query(
    "best_year_month",
    f"""with {views.FINDS_CORE}, {RECOVERY}, m as (select month(date_found) as m, count(*) as n from finds_core group by 1)
        select (select year from recovery order by found / hidden desc, year desc limit 1) as best_year,
               (select monthname(make_date(2000, m, 1)) from m order by n desc, m limit 1) as best_month""",
)
def best_year_month(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder)
    best_year = outliers.recovery_by_group(f.select("year", "number"), "year", "number").agg(
        F.max_by("year", F.struct("recovery_rate", "year")).alias("best_year")
    )
    months = f.groupBy(F.month("date_found").alias("m")).agg(F.count("*").alias("n"))
    best_month = months.agg(F.max_by("m", F.struct("n", -F.col("m"))).alias("m")).select(
        F.date_format(F.make_date(F.lit(2000), F.col("m"), F.lit(1)), "MMMM").alias("best_month")
    )
    return best_year.join(F.broadcast(best_month))


@query(
    "paged_directory",
    f"""with {views.FINDS_CORE}, c as (select spot, count(*) as reports from finds_core group by spot)
        select spot, reports, greatest((select count(*) from c) - 12, 0) as remaining, (select count(*) from c) > 12 as has_more
        from c order by reports desc, spot limit 12""",
)
def paged_directory(spark: SparkSession, folder: str) -> DataFrame:
    return archive.directory_page(spot_counts(spark, folder), [F.col("reports").desc(), F.col("spot").asc()])


# ---------------------------------------------------------------- sets


@query("union_snapshots", "select o_orderkey as id, o_orderstatus as status from orders")
def union_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    parts = [o.where("status = 'F'"), o.where("status = 'O'").select("status", "id"), o.where("status not in ('F', 'O')")]
    return tables.union_snapshots(parts)


@query("missing_keys", "select c_custkey as id from customer except select o_custkey from orders where o_orderpriority = '2-HIGH'")
def missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    required = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    known = table(spark, folder, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("id"))
    return checks.missing_keys(required, known, "id")


@query(
    "missing_state_fields",
    """select event_id, case when event_type = 'view' then 'fetch_status' when event_type = 'error' then 'url,fetch_status'
        else '' end as missing from events""",
)
def missing_state_fields(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    value = F.col("props")
    fields = (
        F.when(kind == "view", F.create_map(F.lit("url"), value))
        .when(kind == "error", F.create_map(F.lit("other"), value))
        .otherwise(F.create_map(F.lit("url"), value, F.lit("fetch_status"), value))
    )
    return table(spark, folder, "events").select(
        "event_id", F.concat_ws(",", checks.missing_fields(["url", "fetch_status"], fields)).alias("missing")
    )


@query(
    "key_coverage",
    f"""with {views.FINDS_CORE}, p as (select distinct dayofyear(date_found) as key from finds_core where status = 'F' and prio = '1-URGENT'),
        s as (select unnest(generate_series(1, 366)) as key)
        select cast(key as integer) as key, 'missing' as problem from s where key not in (select key from p)
        union all select cast(key as integer), 'unexpected' from p where key not in (select key from s)""",
)
def key_coverage(spark: SparkSession, folder: str) -> DataFrame:
    f = views.finds_core(spark, folder).where("status = 'F' and prio = '1-URGENT'")
    return checks.key_coverage(f.select(F.dayofyear("date_found").alias("day")), "day", 1, 366)
