"""Record extraction from landed pages: one narrow job over a table (url, html)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import canonicalize_date
from ..functions.text import absolutize_url, collapse_spaces, html_unescape, let, url_record_id

# Where the pieces of a page are found.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DATA_BEFORE_DATES = r"(?s)var\s+data\s*=\s*(\{.*?\});\s*var\s+dates"
DATA = r"(?s)var\s+data\s*=\s*(\{.*?\});"
DATES = r'var\s+dates\s*=\s*"([^"]+)"'
LINKED_DATA = r"""(?is)<script\s(?:[^>]*\s)?type\s*=\s*["']?application/ld\+json["']?(?=[\s/>])[^>]*>(.*?)</script>"""
DATE_FOUND = r"Date Found:\s*([A-Z][a-z]+ \d{1,2}, \d{4})"
SEASON = r"\b(20\d{2})\b"
META_TAG = r"(?is)<meta[^>]*>"
META_IMAGES = (("property", "og:image"), ("name", "og:image"), ("property", "twitter:image"), ("name", "twitter:image"))

# Words that make a sentence a place, and lead-ins to drop.
PLACE_WORDS = (" near ", " on ", " in ", " under ", " behind ", " at ", " by ", " between ", " off ", " amongst ")
LEAD_INS = (
    r"(?i)^while [^,]+,\s*",
    r"(?i)^(?:i|we)\s+found(?:\s+(?:an\s+orb|the\s+orb|it))?\s+",
    r"(?i)^found(?:\s+(?:an\s+orb|the\s+orb|it))?\s+",
)
SHORT_TEXT = 120

EMBEDDED = T.StructType(
    [
        T.StructField("recid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("image", "imageUrl", "image_url", "thumb", "img")],
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("catName", T.StringType())]))),
    ]
)
LINKED = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("name", "startDate", "location", "image")])
)


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag as written, quoted in any way or not at all; blank without it."""
    value = F.regexp_extract(tag, rf"""(?is)^<(?:[^>]*?[\s"'])?{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute with its entities decoded."""
    return html_unescape(raw_attribute(tag, name))


def of_class(css: str) -> str:
    """Pattern of a class attribute, within a tag, that holds this class."""
    return rf"""\sclass\s*=\s*(?:"(?:[^"]*\s)?{css}(?=[\s"])|'(?:[^']*\s)?{css}(?=[\s'])|{css}(?=[\s>]))"""


def page_title(html: Column) -> Column:
    return collapse_spaces(html_unescape(F.substring_index(F.regexp_extract(html, TITLE, 1), "|", 1)))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags."""

    def strip(markup: Column) -> Column:
        bare = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
        return F.when(markup.contains("<"), F.regexp_replace(bare, r"(?s)<[^>]*>", " ")).otherwise(markup)

    return let(let(html, strip), lambda t: collapse_spaces(html_unescape(t)))


def embedded_data(html: Column) -> Column:
    """Struct of the page's ``var data``, null when it is absent or no JSON object."""

    def parse(pattern: str) -> Column:
        # an unparsable text gives a struct of nulls
        def filled(parsed: Column) -> Column:
            return F.when(F.coalesce(*[parsed[f.name].cast("string") for f in EMBEDDED.fields]).isNotNull(), parsed)

        return let(F.from_json(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")), EMBEDDED), filled)

    return F.coalesce(parse(DATA_BEFORE_DATES), parse(DATA))


def linked_data(html: Column) -> Column:
    """All linked-data objects of the page, in order; unparsable scripts are skipped."""
    scripts = F.regexp_extract_all(html, F.lit(LINKED_DATA), F.lit(1))
    valid = F.filter(scripts, lambda t: F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*[\[{]"))
    objects = F.filter(F.transform(valid, lambda t: F.from_json(t, LINKED)), lambda a: a.isNotNull())
    return F.filter(F.flatten(objects), lambda o: o.isNotNull())


def first_filled(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0)), F.lit(""))


def meta_image(html: Column) -> Column:
    """Content of the first tag of a name, if it is filled; names in the order above."""

    def find(tags: Column) -> Column:
        def content(key: str, name: str) -> Column:
            tag = F.get(F.filter(tags, lambda t: raw_attribute(t, key) == name), F.lit(0))
            return F.trim(raw_attribute(tag, "content"))

        return F.coalesce(*[F.nullif(content(*at), F.lit("")) for at in META_IMAGES], F.lit(""))

    return html_unescape(let(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), find))


def page_date(html: Column, linked: Column) -> Column:
    """Start date of the linked data; only without any linked data the other two places count."""
    started = first_filled(F.transform(linked, lambda o: canonicalize_date(o["startDate"])))
    assigned = canonicalize_date(F.regexp_extract(html, DATES, 1))
    written = canonicalize_date(F.regexp_extract(visible_text(html), DATE_FOUND, 1))
    return F.when(F.size(linked) > 0, started).otherwise(F.coalesce(F.nullif(assigned, F.lit("")), written))


def season_year(data: Column) -> Column:
    """First 20xx in the category names, blank without one."""
    names = F.transform(data["categories"], lambda c: F.regexp_extract(c["catName"], SEASON, 1))
    return first_filled(names)


def resolve_season(season: Column, date_found: Column, first: int, last: int) -> Column:
    """struct(year, problem): an implausible season falls back to the year of the date."""
    value = season.try_cast("int")
    from_date = F.regexp_extract(date_found, r"^(\d{4})-", 1)

    def result(year: Column, problem: str) -> Column:
        return F.struct(year.alias("year"), F.lit(problem).alias("problem"))

    return (
        F.when(season == "", result(F.lit(""), "non_float_event"))
        .when(value.between(first, last), result(season, ""))
        .otherwise(result(from_date, "implausible_season_year"))
    )


def place_from_prose(text: Column) -> Column:
    """First sentence with a place word, lead-ins removed; else a short text as a whole; else blank."""

    def strip_lead(sentence: Column) -> Column:
        return reduce(lambda c, pattern: F.regexp_replace(c, pattern, ""), LEAD_INS, sentence)

    def find(plain: Column) -> Column:
        words = "|".join(PLACE_WORDS)

        def has_place(sentence: Column) -> Column:
            return F.concat(F.lit(" "), F.lower(sentence), F.lit(" ")).rlike(words)

        # dropping a lead-in never adds a word, so only sentences with one are cleaned and tested again
        sentences = F.filter(F.split(plain, r"(?<=[.!?])\s+"), has_place)
        cleaned = F.transform(sentences, lambda s: strip_lead(F.regexp_replace(s, r"^[ \-]+|[ \-]+$", "")))
        hit = F.get(F.filter(cleaned, has_place), F.lit(0))
        whole = F.when(F.length(plain) <= SHORT_TEXT, plain).otherwise(F.lit(""))
        return F.regexp_replace(F.coalesce(F.trim(hit), whole), r"[.!?]+$", "")

    return let(visible_text(F.coalesce(text, F.lit(""))), find)


def page_parts(pages: DataFrame, id_pattern: str) -> DataFrame:
    """Parsed pieces of every page; the two JSON pieces are parsed once."""
    parsed = pages.select(
        "*",
        url_record_id(F.col("url"), id_pattern).alias("_url_id"),
        embedded_data(F.col("html")).alias("_data"),
        linked_data(F.col("html")).alias("_linked"),
    )
    return parsed.select("*", page_date(F.col("html"), F.col("_linked")).alias("_date"))


def page_records(pages: DataFrame, id_pattern: str, first_season: int, last_season: int, base: str) -> DataFrame:
    """Pages -> record fields plus rejection and warning; rejected pages carry blanks.

    Embedded data comes first, then linked data, then title, meta tags and description. Links are resolved against `base`.
    """
    p = page_parts(pages, id_pattern)
    data, linked = F.col("_data"), F.col("_linked")
    text = {n: F.trim(F.coalesce(data[n], F.lit(""))) for n in EMBEDDED.names if n != "categories"}
    data_id, url_id = text["recid"], F.col("_url_id")
    place_names = F.transform(linked, lambda o: F.coalesce(F.get_json_object(o["location"], "$.name"), F.lit("")))
    # an image is a string or a list of strings; objects don't count
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array(F.lit("")))
    images = F.flatten(
        F.transform(linked, lambda o: F.when(o["image"].startswith("["), listed(o["image"])).otherwise(F.array(o["image"])))
    )
    images = F.filter(F.transform(images, lambda c: F.trim(c)), lambda c: ~c.startswith("{"))

    def first_of(*choices: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))

    fields = p.select(
        *pages.columns,
        first_of(data_id, url_id).alias("id"),
        ((data_id != "") & (url_id != "") & (data_id != url_id)).alias("_mismatch"),
        first_of(text["title"], first_filled(F.transform(linked, lambda o: F.trim(F.coalesce(o["name"], F.lit(""))))),
                 page_title(F.col("html"))).alias("title"),
        first_of(text["location"], first_filled(place_names), place_from_prose(text["description"])).alias("location"),
        first_of(
            *[text[n] for n in ("image", "imageUrl", "image_url", "thumb", "img")],
            first_filled(images),
            meta_image(F.col("html")),
        ).alias("image"),
        F.col("_date").alias("date_found"),
        resolve_season(season_year(data), F.col("_date"), first_season, last_season).alias("_season"),
    )
    year, problem = F.col("_season.year"), F.col("_season.problem")
    usable = ~F.col("_mismatch") & (F.col("id") != "") & (year != "") & (F.col("title") != "")
    rejection = F.when(usable, F.lit("")).when(F.col("_mismatch"), F.lit("parse_error")).otherwise(
        first_of(problem, F.lit("parse_error"))
    )
    clean = {
        "id": F.col("id"),
        "year": year,
        "title": collapse_spaces(html_unescape(F.col("title"))),
        "url": absolutize_url(F.trim("url"), base),
        "image": absolutize_url(F.col("image"), base),
        "location": collapse_spaces(html_unescape(F.col("location"))),
        "date_found": F.col("date_found"),
    }
    return fields.select(
        *[c for c in pages.columns if c not in clean],
        *[F.when(usable, c).otherwise(F.lit("")).alias(n) for n, c in clean.items()],
        rejection.alias("rejection"),
        F.when(usable, problem).otherwise(F.lit("")).alias("warning"),
    )


def listing_items(pages: DataFrame, base: str, year: str = "") -> DataFrame:
    """Items of listing pages: id, title, link, image, location; one row per item, links resolved against `base`."""
    events = r"""(?=\s[^>]*\bdata-type\s*=\s*["']?events["'\s>])"""
    opening = rf"(?is)(?=<[a-z][a-z0-9]*{events}(?=(?:\s[^>]*)?{of_class('item')}))"
    chunks = pages.select("*", F.explode(F.split("html", opening)).alias("_item"))
    head = F.regexp_extract("_item", r"(?s)^(<[^>]*>)", 1)

    def inner(css: str) -> Column:
        found = F.regexp_extract("_item", rf"(?is)<([a-z][a-z0-9]*)(?=\s)[^>]*?{of_class(css)}[^>]*>(.*?)</\1>", 2)
        return visible_text(found)

    picture = F.regexp_extract("_item", r"(?is)<img\b[^>]*>", 0)
    anchor = F.regexp_extract("_item", r"(?is)<a\s(?:[^>]*\s)?href\s*=[^>]*>", 0)
    image = html_unescape(F.coalesce(F.nullif(raw_attribute(picture, "data-lazy-src"), F.lit("")), raw_attribute(picture, "src")))
    items = chunks.where(raw_attribute(head, "data-type") == "events").select(
        *[c for c in pages.columns if c != "html"],
        F.trim(raw_attribute(head, "data-recid")).alias("id"),
        F.lit(year).alias("year"),
        inner("title").alias("title"),
        absolutize_url(F.trim(attribute(anchor, "href")), base).alias("link"),
        absolutize_url(F.trim(image), base).alias("image"),
        inner("locations").alias("location"),
    )
    return items.where("id <> ''")


def next_skip(html: Column) -> Column:
    """Offset that the link of the pager to the next listing page has, null on the last one."""
    pager = rf"(?is)<[a-z][a-z0-9]*(?=\s)[^>]*?{of_class('pager')}.*?(<a(?=\s)[^>]*?{of_class('nxt')}[^>]*>)"
    # the link of the pager's own match: others of that class may stand before it
    link = attribute(F.regexp_extract(html, pager, 1), "href")
    return F.regexp_extract(link, r"[?&]skip=(\d+)", 1).try_cast("int")


def link_items(pages: DataFrame, key: str) -> DataFrame:
    """Anchors of every page in order: position, link and text."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s(?:[^>]*\s)?href\s*=[^>]*>.*?</a>"), F.lit(0))
    found = pages.select(key, F.posexplode(anchors).alias("position", "_a"))
    head, inner = F.regexp_extract("_a", r"(?s)^(<[^>]*>)", 1), F.regexp_extract("_a", r"(?is)^<[^>]*>(.*)</a>$", 1)
    return found.select(key, "position", raw_attribute(head, "href").alias("link"), visible_text(inner).alias("text"))
