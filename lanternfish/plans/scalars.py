"""Row-wise cleaning, dates, labels, calendar and geo scalars over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import dates, geo, rules, text
from ..operators import labels
from ..operators.overrides import apply_overrides
from . import views
from .registry import query, table

BASE_URL = "https://archive.example.org/reports/list/"
SPACES_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def nested_replace(column: str, pairs: dict[str, str]) -> str:
    for source, target in pairs.items():
        source, target = source.replace("'", "''"), target.replace("'", "''")
        column = f"replace({column}, '{source}', '{target}')"
    return column


# ---------------------------------------------------------------- text

# entities that occur in the given pages, some of them cut off; the ampersand comes last, so that nothing is decoded twice
ENTITIES = {
    "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0", "&copy;": "©",
    "&middot;": "·", "&amp;": "&", "&amp": "&",
}

ASCII = {**{c: "-" for c in text.DASHES}, "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}
SQUASH_SQL = f"trim(regexp_replace({nested_replace('text', ASCII)}, '{SPACES_SQL}', ' ', 'g'))"
PLACE_SQL = (
    "trim(regexp_replace(regexp_replace(lower("
    + f"trim(regexp_replace({nested_replace(nested_replace('text', text.MOJIBAKE), ASCII)}, '{SPACES_SQL}', ' ', 'g'))"
    + rf"), '\s*-\s*', ' ', 'g'), '{SPACES_SQL}', ' ', 'g'))"
)


@query(
    "squash_text",
    f"""select doc_id, md5({SQUASH_SQL}) as squashed, md5({PLACE_SQL}) as squashed_place,
               length({SQUASH_SQL}) as squashed_length from documents""",
)
def squash_text(spark: SparkSession, folder: str) -> DataFrame:
    squashed = text.squash_text(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(squashed).alias("squashed"),
        F.md5(text.squash_place(F.col("text"))).alias("squashed_place"),
        F.length(squashed).alias("squashed_length"),
    )


@query(
    "html_unescape",
    f"""select page_id, md5({nested_replace('html', ENTITIES)}) as unescaped,
               length({nested_replace('html', ENTITIES)}) as unescaped_length from pages""",
)
def html_unescape(spark: SparkSession, folder: str) -> DataFrame:
    decoded = text.html_unescape(F.col("html"))
    return table(spark, folder, "pages").select(
        "page_id", F.md5(decoded).alias("unescaped"), F.length(decoded).alias("unescaped_length")
    )


@query(
    "absolutize_url",
    f"""with links as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages)
        select page_id, link, count(*) as uses,
               case when link = '' then '' when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then link
                    when link like '//%' then 'https:' || link
                    when link like '/%' then 'https://archive.example.org' || link
                    when link like '?%' or link like '#%' then '{BASE_URL}' || link
                    else '{BASE_URL}' || link end as resolved
        from links group by page_id, link""",
)
def absolutize_url(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")
    )
    return (
        links.groupBy("page_id", "link")
        .agg(F.count("*").alias("uses"))
        .withColumn("resolved", text.absolutize_url(F.col("link"), BASE_URL))
    )


@query(
    "url_record_id",
    r"""select page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1),
               '/[a-z]{2}/([0-9]+)/?$', 1) as record_id from pages""",
)
def url_record_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", text.url_record_id(F.col("url"), r"/[a-z]{2}/(\d+)/?$").alias("record_id")
    )


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of every known shape, composed from number and finder."""
    o = table(spark, folder, "orders")
    number = (F.col("o_custkey") % 3000 + 1).cast("string")
    finder = F.concat(F.lit("Pat "), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    shape = F.col("o_orderkey") % 9
    title = (
        F.when(shape == 0, F.concat(number, F.lit(" – "), finder))
        .when(shape == 1, F.concat(number, F.lit(" "), finder))
        .when(shape == 2, F.concat(F.lit("#"), number, F.lit(", "), finder))
        .when(shape == 3, F.concat(F.lit("Number "), number, F.lit(",  "), finder))
        .when(shape == 4, F.concat(finder, F.lit(" #"), number))
        .when(shape == 5, F.concat(number, F.lit("/"), finder))
        .when(shape == 6, finder)
        .when(shape == 7, number)
        .otherwise(F.concat(finder, F.lit("  "), number))
    )
    return o.select(F.col("o_orderkey").alias("id"), title.alias("title"))


TITLE_PARTS = """parts as (
  select o_orderkey as id, cast(o_custkey % 3000 + 1 as varchar) as n,
         'Pat ' || split_part(o_orderpriority, '-', 2) as f, o_orderkey % 9 as shape from orders)"""


@query(
    "split_number_title",
    f"""with {TITLE_PARTS} select id, case when shape = 6 then '' else n end as number,
        case when shape = 7 then '' else f end as finder from parts""",
)
def split_number_title(spark: SparkSession, folder: str) -> DataFrame:
    parsed = titles(spark, folder).select("id", text.split_number_title(F.col("title")).alias("p"))
    return parsed.select("id", "p.number", "p.finder")


@query(
    "compose_title",
    f"""with {TITLE_PARTS} select id,
        case when shape = 0 then n || ' – ' || f when shape = 1 then n || ' ' || f when shape = 2 then '#' || n || ', ' || f
             when shape = 3 then 'Number ' || n || ', ' || f when shape = 4 then f || ' #' || n
             when shape = 5 then n || '/' || f when shape = 6 then f when shape = 7 then n
             else f || ' ' || n end as kept,
        case when shape = 6 then '' when shape = 7 then n else n || ' ' || f end as rebuilt from parts""",
)
def compose_title(spark: SparkSession, folder: str) -> DataFrame:
    parsed = titles(spark, folder).withColumn("p", text.split_number_title(F.col("title")))
    return parsed.select(
        "id",
        text.compose_title(F.col("p.number"), F.col("p.finder"), F.col("title")).alias("kept"),
        text.compose_title(F.col("p.number"), F.col("p.finder"), F.lit("")).alias("rebuilt"),
    )


@query(
    "parse_year",
    """select o_orderkey as id, case o_orderkey % 4 when 0 then cast(year(o_orderdate) as varchar)
        when 1 then cast(2000 + o_custkey % 100 as varchar) when 2 then '' else '' end as season
       from orders""",
)
def parse_year(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    kind = F.col("o_orderkey") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("Season "), (2000 + F.col("o_custkey") % 100).cast("string"), F.lit(" finds")))
        .when(kind == 2, F.concat(F.lit("Report 20"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")))
        .otherwise(F.lit("unknown"))
    )
    return o.select(
        F.col("o_orderkey").alias("id"), F.coalesce(text.parse_year(raw).cast("string"), F.lit("")).alias("season")
    )


@query(
    "normalize_number",
    """select c_custkey as id, case c_custkey % 3 when 0 then cast(c_custkey as varchar)
        when 1 then cast(c_custkey as varchar) else '#' || c_custkey end as number from customer""",
)
def normalize_number(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" # "), key))
        .when(F.col("c_custkey") % 3 == 1, F.concat(key, F.lit("  ")))
        .otherwise(F.concat(F.lit("##"), key))
    )
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), text.normalize_number(raw).alias("number")
    )


@query("first_integer", "select p_partkey, cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) as n from part")
def first_integer(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", text.first_integer(F.col("p_brand")).alias("n"))
    return rows.where("n is not null")


@query(
    "number_format_check",
    """select l_linenumber % 4 as variant,
        case l_linenumber % 4 when 0 then l_orderkey <= 99999 when 1 then l_orderkey <= 99999 else false end as ok,
        count(*) as lines from lineitem group by 1, 2""",
)
def number_format_check(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    variant = F.col("l_linenumber") % 4
    raw = (
        F.when(variant == 0, key)
        .when(variant == 1, F.concat(key, F.lit("b")))
        .when(variant == 2, F.concat(key, F.lit("bc")))
        .otherwise(F.concat(F.lit("N"), key))
    )
    return (
        table(spark, folder, "lineitem")
        .select(variant.alias("variant"), text.number_format_ok(raw).alias("ok"))
        .groupBy("variant", "ok")
        .agg(F.count("*").alias("lines"))
    )


@query("url_validity", "select page_id, page_id % 4 in (0, 2) as ok from pages")
def url_validity(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("page_id") % 4
    raw = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.regexp_replace("url", "^https?", "ftp"))
        .when(kind == 2, F.lit(" "))
        .otherwise(F.concat(F.lit("not-a-url/"), F.col("page_id")))
    )
    return table(spark, folder, "pages").select("page_id", text.url_is_valid(raw).alias("ok"))


@query(
    "infer_source",
    r"""select case when page_id % 5 = 0 then 'manual' when page_id % 5 = 1 then 'archive'
        else regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') end as source,
        count(*) as pages from pages group by 1""",
)
def infer_source(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("page_id") % 5
    given = F.when(kind == 0, F.lit(" manual ")).otherwise(F.lit(""))
    url = F.when(kind == 1, F.lit("no url")).otherwise(F.col("url"))
    return (
        table(spark, folder, "pages")
        .select(text.infer_source(given, url, "archive").alias("source"))
        .groupBy("source")
        .agg(F.count("*").alias("pages"))
    )


@query("placeholder_flag", "select page_id, contains(url, 'utm_source') as placeholder from pages")
def placeholder_flag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", text.is_placeholder(F.col("url"), "utm_source").alias("placeholder")
    )


# ---------------------------------------------------------------- dates


def date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in ten ways, junk included."""
    d = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 10

    def fmt(pattern: str):
        return F.date_format(d, pattern)

    day = F.dayofmonth(d)
    suffix = (
        F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    )
    raw = (
        F.when(kind == 0, fmt("yyyy-MM-dd"))
        .when(kind == 1, fmt("MMMM d, yyyy"))
        .when(kind == 2, fmt("MMM d, yyyy"))
        .when(kind == 3, fmt("M/d/yyyy"))
        .when(kind == 4, fmt("MM/dd/yy"))
        .when(kind == 5, fmt("yyyy-MM-dd'T'00:00:00"))
        .when(kind == 6, fmt("MMMM yyyy"))
        .when(kind == 7, F.concat(fmt("MMMM d"), suffix, fmt(", yyyy")))
        .when(kind == 8, F.concat(F.lit("sometime in "), fmt("MMMM"), F.lit(" or so")))
        .otherwise(F.lit("13/45/2025"))
    )
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


DATE_PARTS = "d as (select o_orderkey as id, o_orderkey % 10 as k, cast(o_orderdate as date) as d from orders)"


@query(
    "canonicalize_date",
    f"""with {DATE_PARTS} select id, case
        when k in (0, 5) then case when strftime(d, '%m-%d') = '01-01' then '' else strftime(d, '%Y-%m-%d') end
        when k in (1, 2, 3, 4) then strftime(d, '%Y-%m-%d') else '' end as date_found from d""",
)
def canonicalize_date(spark: SparkSession, folder: str) -> DataFrame:
    return date_texts(spark, folder).select("id", dates.canonicalize_date(F.col("raw")).alias("date_found"))


@query(
    "normalize_date_flag",
    f"""with {DATE_PARTS} select id, k in (6, 8, 9) as malformed, case when k = 6 then strftime(d, '%B %Y')
        when k = 8 then 'sometime in ' || strftime(d, '%B') || ' or so' when k = 9 then '13/45/2025'
        else strftime(d, '%Y-%m-%d') end as value from d""",
)
def normalize_date_flag(spark: SparkSession, folder: str) -> DataFrame:
    parsed = date_texts(spark, folder).select("id", dates.normalize_date(F.col("raw")).alias("p"))
    return parsed.select("id", "p.malformed", "p.value")


@query(
    "parse_date_lenient",
    f"""with {DATE_PARTS} select id, case when k in (0, 1, 2, 3, 4) then strftime(d, '%Y-%m-%d')
        when k = 6 then strftime(d, '%Y-%m-01') else '' end as date_found from d""",
)
def parse_date_lenient(spark: SparkSession, folder: str) -> DataFrame:
    parsed = dates.iso(dates.parse_date_lenient(F.col("raw")))
    return date_texts(spark, folder).select("id", F.coalesce(parsed, F.lit("")).alias("date_found"))


@query(
    "month_of_text",
    f"""with {DATE_PARTS} select id, case when k in (5, 9) then 0 else month(d) end as month from d""",
)
def month_of_text(spark: SparkSession, folder: str) -> DataFrame:
    return date_texts(spark, folder).select(
        "id", F.coalesce(dates.month_of_text(F.col("raw")), F.lit(0)).alias("month")
    )


@query(
    "timestamp_local",
    """select event_id, strftime(ts - interval 5 hour, '%b %-d, %Y at %-I:%M %p') || ' EST' as shown,
              strftime(ts - interval 5 hour, '%b %-d, %Y') as shown_date from events""",
)
def timestamp_local(spark: SparkSession, folder: str) -> DataFrame:
    text_ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    instant = dates.parse_instant(text_ts)
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), instant)
    return table(spark, folder, "events").select(
        "event_id",
        dates.local_timestamp_text(instant).alias("shown"),
        dates.public_date(F.date_format(local, "yyyy-MM-dd")).alias("shown_date"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical seven-field records with blanks spread over them."""
    f = views.finds(spark, folder)
    return f.select(
        F.col("id").cast("string").alias("id"),
        F.col("year").cast("string").alias("year"),
        F.concat_ws(" ", F.col("number").cast("string"), F.col("finder")).alias("title"),
        F.concat(F.lit("https://archive.example.org/event/find/"), F.col("id"), F.lit("/")).alias("url"),
        F.when(F.col("prio") == "5-LOW", "")
        .when(F.col("prio") == "4-NOT SPECIFIED", "https://img.example.org/default_image_2__.jpg")
        .otherwise(F.concat(F.lit("https://img.example.org/"), F.col("custkey"), F.lit(".jpg")))
        .alias("image"),
        F.when((F.col("status") == "P") & (F.col("prio") == "1-URGENT"), " ").otherwise(F.col("place")).alias("location"),
        F.when(F.col("status") == "F", "").otherwise(F.col("date_found").cast("string")).alias("date_found"),
    )


RECORDS = views.FINDS + """,
records as (
  select cast(id as varchar) as id, cast(year as varchar) as year, number || ' ' || finder as title,
         'https://archive.example.org/event/find/' || id || '/' as url,
         case when prio = '5-LOW' then '' when prio = '4-NOT SPECIFIED' then 'https://img.example.org/default_image_2__.jpg'
              else 'https://img.example.org/' || custkey || '.jpg' end as image,
         case when status = 'P' and prio = '1-URGENT' then ' ' else place end as location,
         case when status = 'F' then '' else cast(date_found as varchar) end as date_found
  from finds)"""


@query(
    "record_complete",
    f"""with {RECORDS} select id, image <> '' and trim(location) <> '' and date_found <> '' as complete from records""",
)
def record_complete(spark: SparkSession, folder: str) -> DataFrame:
    r = records(spark, folder)
    return r.select("id", text.record_complete([F.col(c) for c in r.columns]).alias("complete"))


@query(
    "apply_overrides",
    """select c_custkey as id,
        case when s_suppkey is null or s_suppkey % 2 = 1 then c_name else s_name end as title,
        case when s_suppkey is null or s_suppkey % 3 <> 0 then c_mktsegment else '' end as location,
        case when s_suppkey is null then '' when s_suppkey % 5 = 0 then 'invalid_float_number,invalid_date'
             else '' end as waivers
       from customer left join supplier on s_suppkey = c_custkey""",
)
def apply_overrides_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("location"),
    )
    key = F.col("s_suppkey")
    fields = F.map_from_entries(
        F.filter(
            F.array(
                F.when(key % 2 == 0, F.struct(F.lit("title_override").alias("k"), F.col("s_name").alias("v"))),
                F.when(key % 3 == 0, F.struct(F.lit("location_override").alias("k"), F.lit("").alias("v"))),
            ),
            lambda e: e.isNotNull(),
        )
    )
    waivers = F.when(key % 5 == 0, F.array(F.lit("invalid_float_number"), F.lit("invalid_date"))).otherwise(
        F.array().cast("array<string>")
    )
    overrides = table(spark, folder, "supplier").select(
        key.cast("string").alias("id"), fields.alias("fields"), waivers.alias("waivers")
    )
    done = apply_overrides(rows, overrides, {"title_override": "title", "location_override": "location"})
    return done.select(
        F.col("id").cast("bigint").alias("id"), "title", "location", F.concat_ws(",", "waivers").alias("waivers")
    )


# ---------------------------------------------------------------- labels

PART_RULES = (
    ("large rod", "Great Pier"),
    ("ring", "Ring Cove"),
    ("old", "Old Mill Road"),
    ("red", "Red Cliff Beach"),
    ("rod", "Angler Dock"),
    ("small", "Little Pond"),
    ("gear", "Gear Market"),
)
PART_CASE = "case " + " ".join(f"when contains(t, '{p}') then '{v}'" for p, v in PART_RULES) + " else 'Other/Unknown' end"
GATES = ("plate", "widget")
NUMBER_PATTERN = r"\btrail\s*#\s*(\d{1,2})\b"
NUMBERED = {str(n): f"Trail Stop {n}" for n in range(1, 12)}
ANCHORS = (("hot", "Furnace Loop"), ("blue", "Lagoon Trail"))


@query("first_match_label", f"with p as (select p_partkey, lower(p_name) as t from part) select p_partkey, {PART_CASE} as label from p")
def first_match_label(spark: SparkSession, folder: str) -> DataFrame:
    table_of_rules = [(k, pattern, label) for k, (pattern, label) in enumerate(PART_RULES)]
    rule_table = spark.createDataFrame(table_of_rules, "rule_order int, pattern string, label string")
    return labels.first_match(table(spark, folder, "part"), "p_name", rule_table).select("p_partkey", "label")


@query(
    "first_match_label_table",
    """with t as (select o_orderkey, o_orderkey::varchar as k from orders where o_orderkey % 7 <> 0),
        p as (select o_orderkey, unnest(list_transform(range(1, len(k) + 1), lambda i: k[1:i]))::bigint as n from t),
        m as (select p.o_orderkey, max(r.o_orderkey) as n from p join orders r on r.o_orderkey = p.n group by 1)
        select o.o_orderkey as id, coalesce(r.o_orderpriority || ' ' || r.o_orderkey, 'Other/Unknown') as label
        from orders o left join m using (o_orderkey) left join orders r on r.o_orderkey = m.n""",
)
def first_match_label_table(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary of one rule per order: lot 12 is part of the text of lot 123 too, so rules of higher numbers come first."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    rule_table = o.select((-F.col("o_orderkey")).alias("rule_order"), F.concat(F.lit("lot "), key).alias("pattern"), F.concat_ws(" ", "o_orderpriority", key).alias("label"))
    word = F.when(F.col("o_orderkey") % 7 == 0, "box ").otherwise("The LOT - ")
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(word, key, F.lit(", sold")).alias("place"))
    return labels.first_match(rows, "place", rule_table).select("id", "label")


@query(
    "gated_label",
    f"""with p as (select p_partkey, p_size, lower(p_name) || ' trail #' || p_size as t from part)
        select p_partkey, case
          when (contains(t, 'plate') or contains(t, 'widget')) and p_size between 1 and 11 then 'Trail Stop ' || p_size
          when (contains(t, 'plate') or contains(t, 'widget')) and contains(t, 'hot') then 'Furnace Loop'
          when (contains(t, 'plate') or contains(t, 'widget')) and contains(t, 'blue') then 'Lagoon Trail'
          else {PART_CASE} end as label from p""",
)
def gated_label(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(" – trail #"), F.col("p_size"))
    return table(spark, folder, "part").select(
        "p_partkey",
        rules.gated_label(raw, GATES, NUMBER_PATTERN, NUMBERED, ANCHORS, PART_RULES).alias("label"),
    )


TAG_SETS = {"waterfront": ("bolt", "hot"), "trail": ("rod", "old"), "town": ("gear", "gizmo")}


@query(
    "multi_label_tags",
    """with g as (select p_brand, p_type, p_size, bool_or(regexp_matches(p_name, 'bolt|hot')) as w,
          bool_or(regexp_matches(p_name, 'rod|old')) as t, bool_or(regexp_matches(p_name, 'gear|gizmo')) as o
        from part group by all)
       select p_brand, p_type, p_size, case when not (w or t or o) then 'mixed' else concat_ws(',',
          case when w then 'waterfront' end, case when t then 'trail' end, case when o then 'town' end) end as tags from g""",
)
def multi_label_tags(spark: SparkSession, folder: str) -> DataFrame:
    flags = {tag: F.bool_or(rules.any_keyword(F.col("p_name"), words)).alias(tag) for tag, words in TAG_SETS.items()}
    grouped = table(spark, folder, "part").groupBy("p_brand", "p_type", "p_size").agg(*flags.values())
    return grouped.select(
        "p_brand",
        "p_type",
        "p_size",
        F.concat_ws(",", rules.tag_list({tag: F.col(tag) for tag in TAG_SETS})).alias("tags"),
    )


CONDITION_CASE = (
    "case " + " ".join(f"when contains(lower(text), '{p}') then '{v}'" for p, v in rules.CONDITIONS)
    + f" else '{rules.DEFAULT_CONDITION}' end"
)


@query(
    "condition_bucket",
    f"""select doc_id, {CONDITION_CASE} as bucket,
        regexp_matches(lower(text), '{"|".join(rules.SEVERE_WORDS)}') as severe from documents""",
)
def condition_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", rules.condition_bucket(F.col("text")).alias("bucket"), rules.is_severe(F.col("text")).alias("severe")
    )


# ---------------------------------------------------------------- calendar

DAYS_SQL = "days as (select cast(o_orderdate as date) as d, count(*) as reports from orders group by 1)"

# Independent of the column version: an explicit holiday dimension.
HOLIDAYS_SQL = """ys as (select unnest(generate_series(1960, 2110)) as y),
md as (select y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), interval 1 day))::date as h from ys),
ranked as (select y, h, month(h) as m, day(h) as dd, isodow(h) as w, (day(h) - 1) // 7 + 1 as nth,
                  day(h + interval 7 day) < day(h) as is_last from md),
hol as (
  select y, h from ranked where (m = 1 and w = 1 and nth = 3) or (m = 2 and w = 1 and nth = 3)
     or (m = 5 and w = 1 and is_last) or (m = 9 and w = 1 and nth = 1) or (m = 10 and w = 1 and nth = 2)
     or (m = 11 and w = 4 and nth = 4)
  union
  select y, (h + case w when 6 then interval (-1) day when 7 then interval 1 day else interval 0 day end)::date
  from ranked where (m = 1 and dd = 1) or (m = 6 and dd = 19) or (m = 7 and dd = 4) or (m = 11 and dd = 11)
     or (m = 12 and dd = 25))"""

MOON_SQL = """moon as (select *, ((date_diff('day', date '2000-01-06', d) % 29.53058867::double + 29.53058867::double)
   % 29.53058867::double) / 29.53058867::double as pos from days)"""
PHASE_CASE = """case when pos < 0.0625 or pos >= 0.9375 then 'new' when pos < 0.1875 then 'waxing_crescent'
  when pos < 0.3125 then 'first_quarter' when pos < 0.4375 then 'waxing_gibbous' when pos < 0.5625 then 'full'
  when pos < 0.6875 then 'waning_gibbous' when pos < 0.8125 then 'last_quarter' else 'waning_crescent' end"""
ILLUM_SQL = "round(0.5 * (1 - cos(2 * pi() * pos)), 4)"
BUCKET_CASE = f"case when {ILLUM_SQL} < 0.25 then 'dark' when {ILLUM_SQL} < 0.6 then 'balanced' else 'bright' end"


@query(
    "calendar_features",
    """select o_orderkey as id, dayofyear(o_orderdate) as day_of_year, month(o_orderdate) as month,
        isodow(o_orderdate) - 1 as weekday, dayname(o_orderdate) as weekday_name,
        isodow(o_orderdate) >= 6 as is_weekend from orders""",
)
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.dayofyear(d).alias("day_of_year"),
        F.month(d).alias("month"),
        cal.weekday(d).alias("weekday"),
        cal.weekday_name(d).alias("weekday_name"),
        cal.is_weekend(d).alias("is_weekend"),
    )


def report_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per date: features of a date are worked out once, not once per report."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("d"))
        .agg(F.count("*").alias("reports"))
    )


@query(
    "holiday_flag",
    f"""with {DAYS_SQL}, {HOLIDAYS_SQL} select cast(d as varchar) as day, reports,
        exists (select 1 from hol where h = d and y = year(d)) as is_holiday from days""",
)
def holiday_flag(spark: SparkSession, folder: str) -> DataFrame:
    return report_days(spark, folder).select(
        F.col("d").cast("string").alias("day"), "reports", cal.is_holiday(F.col("d")).alias("is_holiday")
    )


@query(
    "long_weekend_flag",
    f"""with {DAYS_SQL}, {HOLIDAYS_SQL} select cast(d as varchar) as day, reports,
        isodow(d) in (5, 6, 7, 1) and exists (select 1 from hol where h in (d - 1, d, d + 1)) as is_long_weekend
        from days""",
)
def long_weekend_flag(spark: SparkSession, folder: str) -> DataFrame:
    return report_days(spark, folder).select(
        F.col("d").cast("string").alias("day"), "reports", cal.is_long_weekend(F.col("d")).alias("is_long_weekend")
    )


@query(
    "moon_phase",
    f"""with {DAYS_SQL}, {MOON_SQL} select cast(d as varchar) as day, {PHASE_CASE} as phase,
        {ILLUM_SQL} as illumination, {BUCKET_CASE} as bucket from moon""",
)
def moon_phase(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("d")
    return report_days(spark, folder).select(
        d.cast("string").alias("day"),
        cal.moon_phase(d).alias("phase"),
        cal.moon_illumination(d).alias("illumination"),
        cal.moon_bucket(cal.moon_illumination(d)).alias("bucket"),
    )


@query(
    "cyclic_encoding",
    """select o_orderkey as id, round(sin(2 * pi() * dayofyear(o_orderdate) / 365.0), 9) + 0.0 as sin_day,
        round(cos(2 * pi() * dayofyear(o_orderdate) / 365.0), 9) + 0.0 as cos_day from orders""",
)
def cyclic_encoding(spark: SparkSession, folder: str) -> DataFrame:
    doy = F.dayofyear("o_orderdate")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.round(cal.sin_day(doy), 9) + 0.0).alias("sin_day"),
        (F.round(cal.cos_day(doy), 9) + 0.0).alias("cos_day"),
    )


@query(
    "prepare_features",
    f"""with {views.FINDS}, days as (select distinct date_found as d from finds), {MOON_SQL}, {HOLIDAYS_SQL},
        f as (select id, place, date_found as d from finds where status <> 'F')
        select id, place, year(f.d) as actual_year, dayofyear(f.d) as day_of_year, month(f.d) as month,
          dayname(f.d) as weekday_name, isodow(f.d) >= 6 as is_weekend,
          exists (select 1 from hol where h = f.d and y = year(f.d)) as is_holiday,
          isodow(f.d) in (5, 6, 7, 1) and exists (select 1 from hol where h in (f.d - 1, f.d, f.d + 1)) as is_long_weekend,
          {PHASE_CASE} as moon_phase, {BUCKET_CASE} as moon_bucket,
          round(sin(2 * pi() * dayofyear(f.d) / 365.0), 9) + 0.0 as sin_day,
          round(cos(2 * pi() * dayofyear(f.d) / 365.0), 9) + 0.0 as cos_day
        from f join moon on moon.d = f.d""",
)
def prepare_features_query(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.seasonal import prepare_features

    f = views.finds(spark, folder).select(
        "id",
        "place",
        F.when(F.col("status") == "F", "no date").otherwise(F.date_format("date_found", "MMMM d, yyyy")).alias("raw"),
    )
    prepared = prepare_features(f.withColumn("found", dates.parse_date_lenient(F.col("raw"))), "found", "place")
    return prepared.select(
        "id",
        "place",
        "actual_year",
        "day_of_year",
        "month",
        "weekday_name",
        "is_weekend",
        "is_holiday",
        "is_long_weekend",
        "moon_phase",
        "moon_bucket",
        (F.round("sin_day", 9) + 0.0).alias("sin_day"),
        (F.round("cos_day", 9) + 0.0).alias("cos_day"),
    )


# ---------------------------------------------------------------- geo and units

HAVERSINE_SQL = """3959 * 2 * atan2(
  sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)
       + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)),
  sqrt(1 - (pow(sin(radians({lat2} - {lat1}) / 2), 2)
       + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"""
CENTER_SQL = f"""with {views.SPOTS},
   c as (select label, round(avg(exact_lat), 6) as clat, round(avg(exact_lon), 6) as clon from spots group by label),
   p as (select name, """ + HAVERSINE_SQL.format(lat1="clat", lon1="clon", lat2="exact_lat", lon2="exact_lon") + """ as miles
         from spots join c using (label))"""


def spot_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every spot to the centre of its label."""
    s = views.spots(spark, folder)
    centers = s.groupBy("label").agg(
        F.round(F.avg("exact_lat"), 6).alias("clat"), F.round(F.avg("exact_lon"), 6).alias("clon")
    )
    miles = geo.haversine_miles(F.col("clat"), F.col("clon"), F.col("exact_lat"), F.col("exact_lon"))
    return s.join(centers, "label").select("name", miles.alias("miles"))


@query("haversine_miles", CENTER_SQL + " select name, round(miles, 3) as miles from p")
def haversine_miles(spark: SparkSession, folder: str) -> DataFrame:
    return spot_distances(spark, folder).select("name", F.round("miles", 3).alias("miles"))


@query(
    "distance_label",
    CENTER_SQL
    + """ select name, case when miles < 8 and miles / 80 < 0.1 then 'Under 0.1 mi away'
          else printf('%.1f mi away', miles / 80) end as shown from p""",
)
def distance_label(spark: SparkSession, folder: str) -> DataFrame:
    return spot_distances(spark, folder).select("name", geo.distance_label(F.col("miles") / 80).alias("shown"))


@query(
    "speed_to_unit",
    """select event_id, cast(round_even(case event_type when 'signup' then value * 0.621371 when 'error' then value * 1.15078
        when 'click' then value * 1.0 else value * 2.23694 end, 0) as integer) as mph from events""",
)
def speed_to_unit(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    unit = (
        F.when(kind == "signup", "wmoUnit:km_h-1")
        .when(kind == "error", "Knots")
        .when(kind == "click", "unit:mph")
        .when(kind == "view", "")
        .otherwise("wmoUnit:m_s-1")
    )
    return table(spark, folder, "events").select("event_id", geo.speed_to_mph(F.col("value"), unit).alias("mph"))


@query(
    "mean_of_numbers_in_text",
    """select event_id, case when event_type = 'view' then -1
        else cast(round_even((floor(value) + floor(value) + 7) / 2, 0) as integer) end as mph from events""",
)
def mean_of_numbers_in_text(spark: SparkSession, folder: str) -> DataFrame:
    low = F.floor("value")
    raw = F.when(F.col("event_type") == "view", "calm").otherwise(F.concat(low, F.lit(" to "), low + 7, F.lit(" mph")))
    return table(spark, folder, "events").select(
        "event_id", F.coalesce(geo.mean_of_numbers(raw), F.lit(-1)).alias("mph")
    )


@query(
    "compass_bucket",
    """select event_id, case when event_type = 'view' then 'variable' else
        (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[
        cast(floor(((value * 7) % 360 + 11.25) / 22.5) as integer) % 16 + 1] end as direction from events""",
)
def compass_bucket(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", "variable").otherwise((F.col("value") * 7).cast("string"))
    return table(spark, folder, "events").select("event_id", geo.compass_bucket(raw).alias("direction"))


@query(
    "c_to_f",
    """select event_id, case when event_type = 'error' then 50
        else cast(round_even(value * 9 / 5 + 32, 0) as integer) end as fahrenheit from events""",
)
def c_to_f(spark: SparkSession, folder: str) -> DataFrame:
    celsius = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, folder, "events").select(
        "event_id", geo.celsius_to_fahrenheit(celsius, F.lit(50)).alias("fahrenheit")
    )
