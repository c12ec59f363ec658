from pyspark.sql import functions as F

from lanternfish.operators import pages

URL = "https://h.org/event/a-thing/{0}/"
EMBEDDED = (
    '<html><head><title>x | y</title><script type="application/ld+json">{"@type": "Event", "name": "LD name", "startDate": "2026-03-12"}</script>'
    '</head><script>var data = {"recid": "5741", "title": "12 Ann &amp; Bo", "location": "Clay Head", "categories": '
    '[{"catName": "Found", "catId": 1}, {"catName": "2025 Finds", "catId": 2}]}; var dates = "x";</script></html>'
)


def parse(spark, html, key=5741):
    df = spark.createDataFrame([(URL.format(key), html)], "url string, html string")
    return pages.page_records(df, r"/event/.+?/(\d+)/?$", 2010, 2027, "https://h.org/list/").first()


def test_embedded(spark):
    r = parse(spark, EMBEDDED)
    assert (r["id"], r["year"], r["title"], r["location"], r["date_found"], r["rejection"]) == (
        "5741", "2025", "12 Ann & Bo", "Clay Head", "2026-03-12", "",
    )


def test_id_mismatch_and_missing_categories(spark):
    assert parse(spark, EMBEDDED, 99)["rejection"] == "parse_error"
    ld_only = '<script type="application/ld+json">[{"name": "N", "startDate": "2026-06-12"}]</script>'
    assert parse(spark, ld_only)["rejection"] == "non_float_event"


def test_placeholder_date_is_blank(spark):
    html = EMBEDDED.replace("2026-03-12", "2026-01-01").replace("</html>", "<p>Date Found: January 01, 2026</p></html>")
    assert parse(spark, html)["date_found"] == ""


def test_implausible_season(spark):
    early = parse(spark, EMBEDDED.replace("2025 Finds", "2001 Finds"))
    assert (early["year"], early["warning"], early["rejection"]) == ("2026", "implausible_season_year", "")
    undated = parse(spark, EMBEDDED.replace("2025 Finds", "2001 Finds").replace("2026-03-12", ""))
    assert undated["rejection"] == "implausible_season_year" and undated["id"] == ""


def test_junk_json_is_skipped(spark):
    html = '<title>7 Cat | z</title><script type="application/ld+json">{broken</script><script>var data = {oops};</script>'
    r = parse(spark, html)
    assert r["rejection"] == "non_float_event"


def test_images(column):
    tags = (
        '<meta name="twitter:image" content="t.jpg"><meta content="o.jpg" property="og:image">',
        '<meta property="og:image" content=""><meta name="twitter:image" content="t.jpg">',
        "<p>none</p>",
    )
    assert column(pages.meta_image, tags) == ["o.jpg", "t.jpg", ""]


def test_prose(column):
    texts = [
        "Great day! While hiking, we found it under the big tree. Thanks.",
        "Found the orb behind a wall!",
        "Short text without a place.",
        "x" * 130,
        None,
    ]
    assert column(pages.place_from_prose, texts) == [
        "under the big tree", "behind a wall", "Short text without a place", "", "",
    ]


def test_listing(spark):
    html = (
        '<div class="item" data-type="ads" data-recid="1">no</div>'
        '<div class="x item" data-type="events" data-recid="6001"><a href="/event/a/6001/"><img src="b.gif" data-lazy-src="r.jpg"></a>'
        '<h4 class="title">321 - <i>Avery</i> P.</h4><ul class="locations"><li>Clay Head</li></ul></div>'
        '<div class="item" data-type="events" data-recid="6000"><a href="/event/b/6000/"></a><h4 class="title">120 Kai</h4></div>'
        '<div class="pager"><a class="nxt" href="?x=1&amp;skip=24">next</a></div>'
    )
    df = spark.createDataFrame([(html,)], "html string")
    got = [tuple(r) for r in pages.listing_items(df, "https://h.org/list/", "2026").orderBy("id").collect()]
    assert got == [
        ("6000", "2026", "120 Kai", "https://h.org/event/b/6000/", "", ""),
        ("6001", "2026", "321 - Avery P.", "https://h.org/event/a/6001/", "https://h.org/list/r.jpg", "Clay Head"),
    ]
    assert df.select(pages.next_skip(F.col("html"))).first()[0] == 24
