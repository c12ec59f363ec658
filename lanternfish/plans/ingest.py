"""Incremental ingest, deduplication and output checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import checks, dedupe, ingest
from ..session import cut_lineage
from . import scalars, views
from .registry import query, table

NOW = "2002-01-01T00:00:00+00:00"
URL = "https://archive.example.org/event/find/"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Listed: every order that is not of low priority."""
    o = table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("id"),
        F.concat(F.lit(URL), key, F.lit("/")).alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("sitemap_lastmod"),
    )


def known_records(spark: SparkSession, folder: str) -> DataFrame:
    """Stored: every record that is not pending."""
    r = scalars.records(spark, folder)
    o = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"))
    return r.join(o, "id", "left_semi")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """Tracked: medium and urgent orders; dear ones have changed, medium ones were only bootstrapped."""
    o = table(spark, folder, "orders").where("o_orderpriority in ('1-URGENT', '3-MEDIUM', '5-LOW')")
    key = F.col("o_orderkey").cast("string")
    dear = F.col("o_totalprice") > 300000
    medium = F.col("o_orderpriority") == "3-MEDIUM"
    return o.select(
        key.alias("id"),
        F.when(medium & dear, "").otherwise(F.concat(F.lit(URL), key, F.lit("/"))).alias("url"),
        F.when(medium, "").when(dear, "1990-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("sitemap_lastmod"),
        F.lit("2001-01-01").alias("first_seen_at"),
        F.lit("2001-06-01").alias("last_seen_at"),
        F.when(F.col("o_totalprice") < 200000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("last_fetched_at"),
        F.when(medium & (F.col("o_totalprice") < 450000), "bootstrap").when(medium, "ok").otherwise("ok").alias("fetch_status"),
    )


def fetched(spark: SparkSession, folder: str, work: DataFrame) -> DataFrame:
    """What the crawl brought back for the selected ids; cheap orders stand for failures."""
    o = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    key = F.col("o_orderkey").cast("string")
    record = F.struct(
        F.year("o_orderdate").cast("string").alias("year"),
        F.concat(F.lit("Fetched "), key).alias("title"),
        F.concat(F.lit(URL), key, F.lit("/")).alias("url"),
        F.lit("https://img.example.org/new.jpg").alias("image"),
        F.lit("New place").alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_found"),
    )
    results = o.select(
        key.alias("id"),
        F.when(price < 10000, 404).when(price < 20000, 0).when(price < 30000, 500).otherwise(200).alias("status_code"),
        F.when(price.between(30000, 40000), "parse_error").when(price.between(40000, 50000), "non_float_event").otherwise("").alias(
            "rejection"
        ),
        F.when(price > 490000, "implausible_season_year").otherwise("").alias("warning"),
        record.alias("record"),
    )
    return results.join(work.select("id"), "id", "left_semi")


SOURCES = scalars.RECORDS + f""",
o as (select *, cast(o_orderkey as varchar) as id, '{URL}' || o_orderkey || '/' as url, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
li as (select id, url, day as lastmod from o where o_orderpriority <> '5-LOW'),
ex as (select r.* from records r join o using (id) where o_orderstatus <> 'P'),
st as (select id, case when o_orderpriority = '3-MEDIUM' and o_totalprice > 300000 then '' else url end as url,
          case when o_orderpriority = '3-MEDIUM' then '' when o_totalprice > 300000 then '1990-01-01' else day end as lastmod,
          case when o_totalprice < 200000 then day else '' end as last_fetched_at,
          case when o_orderpriority = '3-MEDIUM' and o_totalprice < 450000 then 'bootstrap' else 'ok' end as fetch_status
       from o where o_orderpriority in ('1-URGENT', '3-MEDIUM', '5-LOW')),
cls as (select li.id, coalesce(st.last_fetched_at, '') as last_fetched_at,
    case when ex.id is null then 'new'
         when st.id is not null and not (st.lastmod = '' and st.fetch_status in ('', 'bootstrap') and (ex.url = '' or ex.url = li.url))
              and (st.url <> li.url or st.lastmod <> li.lastmod) then 'changed'
         when ex.image = '' or trim(ex.location) = '' or ex.date_found = '' then 'incomplete' else 'unchanged' end as change
  from li left join ex on ex.id = li.id left join st on st.id = li.id),
work as (select id, change as reason from cls where change in ('new', 'changed')
  union all (select id, 'backfill' from cls where change = 'incomplete'
    order by case when last_fetched_at = '' then 0 else 1 end, last_fetched_at, cast(id as bigint) desc limit 25)),
got as (select id, case when o_totalprice < 10000 then 'http_404' when o_totalprice < 20000 then 'request_error'
          when o_totalprice < 30000 then 'http_500' when o_totalprice between 30000 and 40000 then 'parse_error'
          when o_totalprice between 40000 and 50000 then 'non_float_event' else 'ok' end as status,
          case when o_totalprice > 490000 then 'implausible_season_year' else '' end as warning, url, day,
          cast(year(o_orderdate) as varchar) as year from o semi join work using (id))"""


@query("classify_changes", f"with {SOURCES} select id, change from cls")
def classify_changes(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.classify_changes(
        listing(spark, folder), known_records(spark, folder), state(spark, folder)
    ).select("id", "change")


def work(spark: SparkSession, folder: str, mode: str = "incremental") -> DataFrame:
    classified = ingest.classify_changes(listing(spark, folder), known_records(spark, folder), state(spark, folder))
    return ingest.select_work(classified, mode)


@query("select_work", f"with {SOURCES} select id, reason from work")
def select_work(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder)


@query(
    "select_work_full",
    f"""with {SOURCES} select id, case change when 'incomplete' then 'backfill' when 'unchanged' then 'forced' else change end as reason from cls""",
)
def select_work_full(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder, "full")


@query("select_work_new_only", f"with {SOURCES} select id, 'new' as reason from cls where change = 'new'")
def select_work_new_only(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder, "new-only")


def sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # the work list is handed to a crawl, so it is a table: classified once
    chosen = cut_lineage(work(spark, folder))
    joined = ingest.join_sources(
        listing(spark, folder), known_records(spark, folder), state(spark, folder), fetched(spark, folder, chosen)
    )
    return joined, chosen


@query(
    "merge_upsert",
    f"""with {SOURCES}, good as (select * from got where status = 'ok')
        select coalesce(g.id, ex.id) as id, coalesce(g.year, ex.year) as year,
          case when g.id is not null then 'Fetched ' || g.id else ex.title end as title, coalesce(g.url, ex.url) as url,
          case when g.id is not null then 'https://img.example.org/new.jpg' else ex.image end as image,
          case when g.id is not null then 'New place' else ex.location end as location, coalesce(g.day, ex.date_found) as date_found
        from ex full join good g on g.id = ex.id""",
)
def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.merge_upsert(sources(spark, folder)[0])


@query(
    "next_state",
    f"""with {SOURCES}, ids as (select id from li union select id from ex union select id from st)
        select i.id,
          case when li.id is not null then li.url when st.url is not null and st.url <> '' then st.url else coalesce(ex.url, '') end as url,
          case when li.id is not null then li.lastmod else coalesce(st.lastmod, '') end as sitemap_lastmod,
          case when st.id is not null then '2001-01-01' when li.id is not null then '{NOW}' else '' end as first_seen_at,
          case when li.id is not null then '{NOW}' when st.id is not null then '2001-06-01' else '' end as last_seen_at,
          case when got.id is not null then '{NOW}' else coalesce(st.last_fetched_at, '') end as last_fetched_at,
          case when got.id is not null then got.status
               when li.id is null and ex.id is not null then 'missing_from_sitemap'
               when li.id is null then st.fetch_status
               when ex.id is not null and coalesce(st.fetch_status, 'bootstrap') = 'bootstrap' then 'cached'
               else coalesce(st.fetch_status, 'discovered') end as fetch_status
        from ids i left join li on li.id = i.id left join ex on ex.id = i.id left join st on st.id = i.id left join got on got.id = i.id""",
)
def next_state(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.next_state(sources(spark, folder)[0], NOW)


@query(
    "ingest_report",
    f"""with {SOURCES} select (select count(*) from li) as listed, (select count(*) from got) as fetched,
        (select count(*) from li semi join ex using (id) anti join got using (id)) as reused,
        (select count(*) from cls where change = 'new') as new, (select count(*) from cls where change = 'changed') as changed,
        (select count(*) from ex anti join li using (id)) as missing_from_sitemap,
        (select count(*) from got where status = 'http_404') as detail_404,
        (select count(*) from got where status in ('request_error', 'http_500')) as request_error,
        (select count(*) from got where status = 'parse_error') as parse_error,
        (select count(*) from got where status = 'non_float_event') as non_float_event,
        (select count(*) from got where status = 'ok' and warning <> '') as implausible_season_year,
        (select count(*) from work where reason = 'backfill') as backfilled, cast(0 as bigint) as forced""",
)
def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    joined, chosen = sources(spark, folder)
    return ingest.ingest_report(joined, chosen)


@query(
    "enrich_from_previous",
    f"""with {SOURCES} select l.id, case when l.url <> '' then l.url else coalesce(ex.url, '') end as url, coalesce(ex.title, '') as title,
        coalesce(ex.image, '') as image, coalesce(ex.location, '') as location,
        case when coalesce(ex.date_found, '') <> '' then ex.date_found else l.lastmod end as date_found
        from li l left join ex on ex.id = l.id""",
)
def enrich_from_previous(spark: SparkSession, folder: str) -> DataFrame:
    rows = listing(spark, folder).select(
        "id",
        "url",
        F.lit("").alias("title"),
        F.lit("").alias("image"),
        F.lit("").alias("location"),
        F.col("sitemap_lastmod").alias("date_found"),
    )
    return ingest.enrich_from_previous(rows, known_records(spark, folder))


# ---------------------------------------------------------------- duplicates

LABEL_RULES = (("nation_1", "First Shore"), ("nation_2", "Second Shore"), ("nation_5", "Fifth Shore"))
KEYED = scalars.RECORDS + """,
keyed as (
  select r.*, split_part(title, ' ', 1) as number, split_part(title, ' ', 2) as finder,
    case when contains(lower(location), 'nation_1') then 'First Shore' when contains(lower(location), 'nation_2') then 'Second Shore'
         when contains(lower(location), 'nation_5') then 'Fifth Shore' else 'Other/Unknown' end as place from records r),
grouped as (
  select *, case when place = 'Other/Unknown' then id else '' end as own,
    row_number() over (partition by year, number, place, case when place = 'Other/Unknown' then id else '' end
      order by case when date_found = '' then 0 else 1 end desc,
        case when image = '' then 0 when contains(image, 'default_image') then 1 else 2 end desc,
        length(location) desc, cast(id as bigint) desc) as rk,
    count(*) over (partition by year, number, place, case when place = 'Other/Unknown' then id else '' end) as copies
  from keyed)"""


def label():
    return rules.place_label(F.col("location"), LABEL_RULES)


@query("dedupe_best_record", f"with {KEYED} select year, number, place, id as kept_id, copies from grouped where rk = 1")
def dedupe_best_record(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.dedupe_best_record(scalars.records(spark, folder), label())


@query(
    "survivorship_merge",
    f"""with {KEYED}, agg as (select year, number, place, own, max(length(trim(location))) as ll, max(date_found) as d,
          max(case when image <> '' and not contains(image, 'default_image') then lpad(length(image)::varchar, 5, '0') || image end) as im,
          max(lpad(length(finder)::varchar, 5, '0') || finder) as f,
          max(case when trim(location) <> '' then lpad(length(trim(location))::varchar, 5, '0') || trim(location) end) as loc,
          max(case when image <> '' then lpad(length(image)::varchar, 5, '0') || image end) as anyim
        from grouped group by year, number, place, own)
        select b.id, b.year, case when copies > 1 then b.number || ' ' || substr(f, 6) else title end as title, b.url,
          case when copies = 1 then b.image when im is not null then substr(im, 6) when b.image <> '' then b.image
               else coalesce(substr(anyim, 6), '') end as image,
          case when copies > 1 then coalesce(substr(loc, 6), location) else location end as location,
          case when copies > 1 then d else date_found end as date_found, b.number, b.place, copies
        from grouped b join agg using (year, number, place, own) where rk = 1""",
)
def survivorship_merge(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.merge_duplicates(scalars.records(spark, folder), label())


@query(
    "merge_report",
    f"""with {KEYED} select g.year, g.number, g.place, b.id as kept_id, g.id as merged_id from grouped g
        join grouped b using (year, number, place, own) where b.rk = 1 and g.copies > 1 and g.own = ''""",
)
def merge_report(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.merge_report(scalars.records(spark, folder), label())


# ---------------------------------------------------------------- checks


@query(
    "output_checks",
    f"""with {scalars.RECORDS}, r as (select id, year, date_found from records union all
            select id, year, date_found from records where image = '' and date_found = '' and year = '1995'),
        t as (select id from records where not (image = '' and trim(location) <> '' and year = '1999')),
        snap as (select id, case when year = '2001' and image = '' then '2000' else year end as year from records),
        st as (select id, image <> '' as has_status from records where year <> '1997'),
        d as (select distinct dayofyear(date_found::date) as k from records where date_found <> '' and image = ''),
        m as (select count(*) as total, max(nullif(date_found, '')) as latest from records where date_found <> '')
        select 'duplicate_ids' as check, id as detail from r group by id having count(*) > 1
        union all select 'id_drift', 'records:' || id from (select distinct id from r) anti join t using (id)
        union all select 'manifest_total', total || ':' || (select count(*) from r) from m where total <> (select count(*) from r)
        union all select 'snapshot_drift', 'records:' || year || ':' || id from (select distinct id, year from r) anti join snap using (id, year)
        union all select 'snapshot_drift', 'snapshots:' || year || ':' || id from snap anti join r using (id, year)
        union all select 'state_missing_id', id from (select distinct id from r) anti join st using (id)
        union all select 'state_missing_field', id || ':fetch_status' from st where not has_status
        union all select 'artifact_days', 'missing:' || k from (select unnest(generate_series(1, 366)) as k) anti join d using (k)
        union all select 'artifact_months', 'missing:12'""",
)
def output_checks(spark: SparkSession, folder: str) -> DataFrame:
    base = scalars.records(spark, folder)
    blank_image = F.col("image") == ""
    again = base.where(blank_image & (F.col("date_found") == "") & (F.col("year") == "1995"))
    columns = ["id", "year", "date_found"]
    records = base.select(*columns).unionByName(again.select(*columns))
    stored = base.where(~(blank_image & (F.trim("location") != "") & (F.col("year") == "1999"))).select("id")
    manifest = base.where("date_found <> ''").agg(
        F.count("*").alias("total_records"), F.max("date_found").alias("latest_source_date")
    )
    snapshots = base.select("id", F.when((F.col("year") == "2001") & blank_image, "2000").otherwise(F.col("year")).alias("year"))
    value = F.col("title")
    fields = F.when(blank_image, F.create_map(F.lit("url"), value)).otherwise(
        F.create_map(F.lit("url"), value, F.lit("fetch_status"), value)
    )
    tracked = base.where("year <> '1997'").select("id", fields.alias("fields"))
    dated = base.where((F.col("date_found") != "") & blank_image)
    days = dated.select(F.dayofyear(F.col("date_found").cast("date")).alias("day"))
    months = base.where("date_found <> ''").select(F.month(F.col("date_found").cast("date")).alias("month")).where("month <> 12")
    return checks.output_checks(records, stored, manifest, snapshots, tracked, days, months)
