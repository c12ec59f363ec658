"""Page extraction queries: the landed pages, and detail pages written from the archive itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pages
from . import views
from .registry import query, table
from .scalars import BASE_URL, ENTITIES, SPACES_SQL, nested_replace

ID_PATTERN = r"/event/.+?/(\d+)/?$"
FIRST_SEASON, LAST_SEASON = 2006, 2010


@query(
    "page_title",
    f"""select page_id, trim(regexp_replace({nested_replace("split_part(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '|', 1)",
        ENTITIES)}, '{SPACES_SQL}', ' ', 'g')) as title from pages""",
)
def page_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query("blocked_page_flag", "select page_id, contains(lower(html), 'access denied') as blocked from pages")
def blocked_page_flag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.is_blocked_page(F.col("html")).alias("blocked"))


@query(
    "link_items",
    r"""with l as (select page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1) as links,
              regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) as texts from pages)
        select page_id, (i - 1)::integer as position, links[i] as link, trim(texts[i]) as text
        from (select *, unnest(generate_series(1, len(links))) as i from l)""",
)
def link_items(spark: SparkSession, folder: str) -> DataFrame:
    return pages.link_items(table(spark, folder, "pages"), "page_id")


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One detail page per report, in six shapes that pages of the source come in."""
    f = views.finds(spark, folder)
    shape = F.col("id") % 6
    key = F.col("id").cast("string")
    title = F.concat_ws(" ", F.col("number").cast("string"), F.col("finder"))
    iso = F.date_format("date_found", "yyyy-MM-dd")
    long_date = F.date_format("date_found", "MMMM d, yyyy")
    season = F.concat(F.lit("Finds "), (F.col("year") + 10).cast("string"))
    data = F.to_json(
        F.struct(
            F.when(shape == 2, F.concat(F.lit("9"), key)).otherwise(key).alias("recid"),
            title.alias("title"),
            F.when(shape != 3, F.concat(F.col("place"), F.lit(" &amp; around"))).alias("location"),
            F.when(shape == 3, F.concat(F.lit("<p>Lovely day. We found it under a tree in "), F.col("place"), F.lit("!</p>"))).alias(
                "description"
            ),
            F.array(
                F.struct(F.lit("All").alias("catName"), F.lit(1).alias("catId")),
                F.struct(season.alias("catName"), F.lit(2).alias("catId")),
            ).alias("categories"),
            F.when(shape == 0, F.lit("https://img.example.org/embedded.jpg")).alias("image"),
        )
    )
    linked = F.to_json(
        F.struct(
            F.lit("Event").alias("@type"),
            title.alias("name"),
            F.when(shape != 4, iso).alias("startDate"),
            F.struct(F.col("zone").alias("name")).alias("location"),
        )
    )
    html = F.concat(
        F.lit("<html><head><title>"),
        title,
        F.lit(" | Archive</title>"),
        F.when(shape == 5, "<meta content='../list/./meta.jpg?a=1&amp;b=2' property=og:image>").otherwise(""),
        F.when(
            shape.isin(0, 1, 2, 4), F.concat(F.when(shape == 4, "<script async type='application/ld+json'>").otherwise('<script type="application/ld+json">'), linked, F.lit("</script>"))
        ).otherwise(""),
        F.lit("</head><body>"),
        F.when(shape != 1, F.concat(F.lit("<script>var data = "), data, F.lit(";"))).otherwise("<script>"),
        F.when(shape == 3, F.concat(F.lit(' var dates = "'), long_date, F.lit('";'))).otherwise(""),
        F.lit("</script>"),
        F.when(shape == 5, F.concat(F.lit("<p><b>Date Found:</b> "), long_date, F.lit("</p>"))).otherwise(""),
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://archive.example.org/event/a-find/"), key, F.lit("/"))
    return f.select(F.col("id").alias("report_id"), url.alias("url"), html.alias("html"))


PARTS = views.FINDS + f""",
parts as (select id, id % 6 as shape, number || ' ' || finder as title, place, zone, year, (year + 10)::varchar as season,
   strftime(date_found, '%Y-%m-%d') as iso, strftime(date_found, '%m-%d') = '01-01' as new_year from finds),
dated as (select *, case when shape in (3, 5) then iso when shape = 4 or new_year then '' else iso end as date_found from parts),
resolved as (select *, shape <> 1 and season::integer between {FIRST_SEASON} and {LAST_SEASON} as plausible,
   case when shape = 1 then '' when season::integer between {FIRST_SEASON} and {LAST_SEASON} then season else left(date_found, 4) end as rec_year from dated),
judged as (select *, shape not in (1, 2) and rec_year <> '' as ok from resolved)"""


@query(
    "page_record",
    f"""with {PARTS} select id as report_id, case when ok then id::varchar else '' end as id, case when ok then rec_year else '' end as year,
        case when ok then title else '' end as title, case when ok then 'https://archive.example.org/event/a-find/' || id || '/' else '' end as url,
        case when ok and shape = 0 then 'https://img.example.org/embedded.jpg' when ok and shape = 5 then 'https://archive.example.org/reports/list/meta.jpg?a=1&b=2' else '' end as image,
        case when not ok then '' when shape = 3 then 'We found it under a tree in ' || place else place || ' & around' end as location,
        case when ok then date_found else '' end as date_found,
        case when ok then '' when shape = 2 then 'parse_error' when shape = 1 then 'non_float_event' else 'implausible_season_year' end as rejection,
        case when ok and not plausible then 'implausible_season_year' else '' end as warning from judged""".replace(
        "'We found it under a tree in ' || place", "'under a tree in ' || place"
    ),
)
def page_record(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_records(
        detail_pages(spark, folder).select("report_id", "url", "html"), ID_PATTERN, FIRST_SEASON, LAST_SEASON, BASE_URL
    ).drop("html")


@query(
    "page_embedded_json",
    f"""with {PARTS} select id as report_id, case when shape = 1 then '' when shape = 2 then '9' || id else id::varchar end as recid,
        case when shape = 1 then '' else 'All,Finds ' || season end as categories,
        case when shape in (0, 1, 2, 4) then title || '/' || case when shape = 4 then '' else iso end || '/' || zone else '' end as linked from parts""",
)
def page_embedded_json(spark: SparkSession, folder: str) -> DataFrame:
    parsed = detail_pages(spark, folder).select(
        "report_id", pages.embedded_data(F.col("html")).alias("d"), pages.linked_data(F.col("html")).alias("l")
    )
    linked = F.transform(
        "l",
        lambda o: F.concat_ws(
            "/", o["name"], F.coalesce(o["startDate"], F.lit("")), F.get_json_object(o["location"], "$.name")
        ),
    )
    return parsed.select(
        "report_id",
        F.coalesce("d.recid", F.lit("")).alias("recid"),
        F.coalesce(F.concat_ws(",", F.transform("d.categories", lambda c: c["catName"])), F.lit("")).alias("categories"),
        F.concat_ws(",", linked).alias("linked"),
    )


@query("page_date", f"with {PARTS} select id as report_id, date_found from dated")
def page_date(spark: SparkSession, folder: str) -> DataFrame:
    d = detail_pages(spark, folder).withColumn("linked", pages.linked_data(F.col("html")))
    return d.select("report_id", pages.page_date(F.col("html"), F.col("linked")).alias("date_found"))


@query(
    "page_season_year",
    f"""with {PARTS} select id as report_id, rec_year as year, case when shape = 1 then 'non_float_event' when plausible then ''
        else 'implausible_season_year' end as problem from resolved""",
)
def page_season_year(spark: SparkSession, folder: str) -> DataFrame:
    parts = pages.page_parts(detail_pages(spark, folder), ID_PATTERN)
    season = pages.resolve_season(pages.season_year(F.col("_data")), F.col("_date"), FIRST_SEASON, LAST_SEASON)
    return parts.select("report_id", season.alias("s")).select("report_id", "s.year", "s.problem")


PROSE_PLACES = "(?: near | on | in | under | behind | at | by | between | off | amongst )"


@query(
    "place_from_prose",
    rf"""with t as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'g'),
             '(?s)<[^>]*>', ' ', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) as plain from documents),
        s as (select doc_id, plain, list_transform(string_split(regexp_replace(plain, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)),
             lambda x: regexp_replace(regexp_replace(regexp_replace(trim(x, ' -'), '(?i)^while [^,]+,\s*', ''),
                '(?i)^(?:i|we)\s+found(?:\s+(?:an\s+orb|the\s+orb|it))?\s+', ''), '(?i)^found(?:\s+(?:an\s+orb|the\s+orb|it))?\s+', '')) as parts from t),
        h as (select doc_id, plain, list_filter(parts, lambda x: regexp_matches(' ' || lower(x) || ' ', '{PROSE_PLACES}'))[1] as hit from s)
        select doc_id, md5(regexp_replace(coalesce(trim(hit), case when length(plain) <= 120 then plain else '' end), '[.!?]+$', '')) as place from h""",
)
def place_from_prose(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(pages.place_from_prose(F.col("text"))).alias("place")
    )


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One listing page per customer with an item for each of their reports, in the order of ids."""
    f = views.finds(spark, folder)
    key = F.col("id").cast("string")
    item = F.concat(
        F.lit("<div data-type=events class='big item' data-recid=\""),
        key,
        F.lit('"><a href="/event/a-find/'),
        key,
        F.lit('/"><img src="/blank.gif" data-lazy-src="https://img.example.org/'),
        key,
        F.lit('.jpg"></a><h4 class="title"><b>'),
        F.col("number").cast("string"),
        F.lit("</b> &amp; "),
        F.col("finder"),
        F.lit('</h4><ul class="locations">'),
        F.col("place"),
        F.lit("</ul></div>"),
    )
    skip = (F.col("custkey") % 40 * 24).cast("string")
    items = f.groupBy("custkey").agg(F.sort_array(F.collect_list(F.struct("id", item.alias("html")))).alias("items"))
    html = F.concat(
        F.lit('<html><div class="item ad">x</div><a class="nxt" href="/list?skip=7">elsewhere</a>'),
        F.array_join(F.transform("items", lambda x: x["html"]), "\n"),
        F.lit('<div class="pager"><a href="/list?a=1&amp;skip='), skip, F.lit('" class=nxt>more</a></div></html>'),
    )
    return items.select(F.col("custkey").alias("page"), html.alias("html"))


@query(
    "listing_items",
    f"""with {views.FINDS} select custkey as page, id::varchar as id, '1999' as year, number || ' & ' || finder as title, 'https://archive.example.org/event/a-find/' || id || '/' as link,
        'https://img.example.org/' || id || '.jpg' as image, place as location from finds""",
)
def listing_items(spark: SparkSession, folder: str) -> DataFrame:
    return pages.listing_items(listing_pages(spark, folder), BASE_URL, "1999")


@query("listing_next_skip", f"with {views.FINDS} select distinct custkey as page, (custkey % 40 * 24)::integer as next_skip from finds")
def listing_next_skip(spark: SparkSession, folder: str) -> DataFrame:
    return listing_pages(spark, folder).select("page", pages.next_skip(F.col("html")).alias("next_skip"))
