import html
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import text

TITLES = {
    "267 - B. Marlow": ("267", "B. Marlow"),
    "245 Ivy K.": ("245", "Ivy K."),
    "305": ("305", ""),
    "#253, Lena Pike": ("253", "Lena Pike"),
    "#67-Dora Sand": ("67", "Dora Sand"),
    "Number 355, Arlo Penn": ("355", "Arlo Penn"),
    "Gwendolyn #170": ("170", "Gwendolyn"),
    "207/Cole Abbot": ("207", "Cole Abbot"),
    "Finder Only": ("", "Finder Only"),
    "12 – Long  Dash": ("12", "Long Dash"),
    "Someone 88?": ("88", "Someone"),
    "no number 12": ("", "no number 12"),
    "unclear name #12": ("", "unclear name #12"),
    "": ("", ""),
}


def test_titles(column):
    got = column(text.split_number_title, list(TITLES))
    assert [(r["number"], r["finder"]) for r in got] == list(TITLES.values())


def test_titles_null_is_blank(column):
    assert tuple(column(text.split_number_title, [None])[0]) == ("", "")


def test_compose_title(spark):
    cases = [
        ("12", "Ann", "", "12 Ann"),
        ("12", "Ann", "#12, Ann", "#12, Ann"),
        ("12", "Ann", "12 Bob", "12 Ann"),
        ("", "Ann", "Ann", "Ann"),
        ("12", "", "Number 12", "Number 12"),
        ("12", "", "Number 13", "12"),
        ("12", "", "12", "12"),
    ]
    rows = spark.createDataFrame(cases, "n string, f string, t string, want string")
    for r in rows.select("want", text.compose_title(F.col("n"), F.col("f"), F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_squash(column):
    assert column(text.squash_text, ["  a –  b…“c” ", None]) == ['a - b..."c"', ""]
    assert column(text.squash_place, ["Rod’s  HILL - Top", "Bobâ€™s Beach"]) == ["rod's hill top", "bob's beach"]


def test_unescape_as_html_defines(column):
    texts = [
        "&egrave; &#233; &#8230; &#x2019; &pound;", "&#X1F600;&#128512", "&#128; &#150;", "&#0; &#xD800; &#1114112; &#99999999999;", "&#1;x&#127;y",
        "&notin; &notit; &amp &ampx &unknown; & &; &# &#x; &&lt;", "a&amp;#39;b", "", "&NotEqualTilde;", "&#0000000000065;",
    ]
    assert column(text.html_unescape, texts) == [html.unescape(t) for t in texts]


@pytest.mark.parametrize("base", ["https://h.org/list/all/", "https://h.org/list/page", "https://h.org/"])
def test_links_are_resolved_as_urls_are(column, base):
    links = ["../c", "/x/../y", "c/./d", "..", ".", "./", "../../../e", "a//b/../c?x=../y", "/a/b/..", "d#../e", "f.g/..h", "?q=1"]
    assert column(lambda c: text.absolutize_url(c, base), links) == [urljoin(base, x) for x in links]


def test_unescape_decodes_once(column):
    assert column(text.html_unescape, ["a &amp;lt; b", "&quot;x&quot; &amp;amp; y", "R&#39;s"]) == ["a &lt; b", '"x" &amp; y', "R's"]


@pytest.mark.parametrize(
    "link, want",
    [
        ("", ""),
        ("https://a.org/x", "https://a.org/x"),
        ("//cdn.org/i.jpg", "https://cdn.org/i.jpg"),
        ("/event/1/", "https://h.org/event/1/"),
        ("page2", "https://h.org/list/all/page2"),
        ("?skip=24", "https://h.org/list/all/?skip=24"),
    ],
)
def test_absolutize(column, link, want):
    assert column(lambda c: text.absolutize_url(c, "https://h.org/list/all/"), [link]) == [want]


def test_record_id(column):
    urls = ["https://h.org/event/a-b/5741/", "https://h.org/event/x/3633?y=1", "https://h.org/blog/12/", "no url", None]
    assert column(text.url_record_id, urls) == ["5741", "3633", "", "", ""]


def test_years_and_numbers(column):
    assert column(text.parse_year, ["2024", " 2024 ", "Season 2019 finds", "FY 120194", "x", None]) == [2024, 2024, 2019, None, None, None]
    assert column(text.normalize_number, ["#12", " # 12 ", "12", None]) == ["12", "12", "12", ""]
    assert column(text.first_integer, ["a12b3", "none"]) == [12, None]
    assert column(text.number_format_ok, ["12", "12345a", "123456", "12ab", ""]) == [True, True, False, False, False]


def test_urls(column):
    assert column(text.url_is_valid, ["", None, "https://a.org/x", "ftp://a.org", "not-a-url", "http://"]) == [
        True, True, True, False, False, False,
    ]
    got = column(lambda c: text.infer_source(F.lit(" "), c, "archive"), ["https://WWW.A.org/x", "x", None])
    assert got == ["a.org", "archive", "archive"]
