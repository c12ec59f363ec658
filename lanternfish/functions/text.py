"""Text cleaning, titles, years, numbers and URLs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import html5
from json import dumps
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their ASCII form.
DASHES = "–—―−"
SINGLE_QUOTES = "‘’"
DOUBLE_QUOTES = "“”"
ELLIPSIS = "…"

# Double-encoded quotes seen in place texts.
MOJIBAKE = {
    "â€™": "'",
    "â€˜": "'",
    "â€œ": '"',
    "â€�": '"',
}

# Every character str.split() would treat as white space.
SPACE_CLASS = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Named entities as HTML defines them; some are also known without a semicolon, the longest such name counts.
NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
BARE = {name: value for name, value in html5.items() if not name.endswith(";")}
COMMON = {name: NAMED[name] for name in ("amp", "quot", "apos", "lt", "gt", "nbsp")}
# Numbers 128 to 159 mean characters of Windows-1252, where it has one.
C1 = "".join(map(chr, range(128, 160)))
C1_MEANING = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))

# The four title shapes, tried in this order.
NUMBER_FIRST = r"(?i)^(?:number\s+)?#?(\d+)(?:\??\s*(?:[-,/:.!]\s*|\s+)(.+))?$"
FINDER_HASH_NUMBER = r"^(.+?)\s+#(\d+)\??$"
FINDER_NUMBER = r"^(.+?)\s+(\d{1,4})\??$"
WORD_NUMBER = r"(?i)^number\s+(\d+)(?:\s*[-,/:.!]\s*|\s+)(.+)$"

# Accepted number format, image placeholder token, blocked-page token.
NUMBER_FORMAT = r"^\d{1,5}[A-Za-z]?$"
PLACEHOLDER_TOKEN = "default_image"
BLOCKED_TOKEN = "access denied"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that uses it many times; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_CLASS + "+", " "))


def squash_text(c: Column) -> Column:
    """Typographic characters to ASCII, white space collapsed; null becomes blank."""
    ascii_text = F.translate(
        F.coalesce(c, F.lit("")),
        DASHES + SINGLE_QUOTES + DOUBLE_QUOTES,
        "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES),
    )
    return collapse_spaces(F.replace(ascii_text, F.lit(ELLIPSIS), F.lit("...")))


def squash_place(c: Column) -> Column:
    """Place texts: also repair double encoding, lower the case and drop hyphens between words."""
    repaired = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])),
        MOJIBAKE.items(),
        F.coalesce(c, F.lit("")),
    )
    return collapse_spaces(F.regexp_replace(F.lower(squash_text(repaired)), r"\s*-\s*", " "))


def _lookup(table: dict[str, str], name: Column) -> Column:
    """Value of a name in a fixed table, null for others; the table is one literal."""
    return F.try_element_at(F.from_json(F.lit(dumps(table)), "map<string,string>"), name)


def _character(code: Column) -> Column:
    """Character of a code point; no character for controls and noncharacters, U+FFFD outside of Unicode."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = (code < 32) & ~code.isin(9, 10, 12, 13) | (code == 127)
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE), F.lit(""))
        .otherwise(F.translate(char, C1, C1_MEANING))
    )


def _decoded(piece: Column) -> Column:
    """Text that follows an ampersand, with the entity at its start decoded."""
    number, name = r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", r"^([^\t\n\f <&#;]{1,32});"
    bare = f"^({'|'.join(sorted(BARE, key=len, reverse=True))})"
    hexadecimal = F.conv(F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,7})(?![0-9a-fA-F])", 1), 16, 10)
    decimal = F.regexp_extract(piece, r"^#0*([0-9]{1,8})(?![0-9])", 1)
    # zero and what is too long for a code point give the replacement character
    code = F.coalesce(F.when(piece.rlike("^#[xX]"), hexadecimal).otherwise(decimal).try_cast("long"), F.lit(0))
    whole = F.regexp_extract(piece, name, 1)
    known = F.coalesce(_lookup(COMMON, whole), _lookup(NAMED, whole))
    return (
        F.when(piece.rlike(number), F.concat(_character(code), F.regexp_replace(piece, number, "")))
        .when((whole != "") & known.isNotNull(), F.concat(known, F.regexp_replace(piece, name, "")))
        .when(piece.rlike(bare), F.concat(_lookup(BARE, F.regexp_extract(piece, bare, 1)), F.regexp_replace(piece, bare, "")))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def html_unescape(c: Column) -> Column:
    """Decode numeric and named entities, once and from left to right; what is none stays."""

    def decode(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decoded)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return let(c, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), decode)).otherwise(t))


def _without_dots(path: Column) -> Column:
    """Path with its `.` and `..` segments resolved; `..` does not leave the root."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    # a last dot segment names a folder
    segments = F.split(F.regexp_replace(path, r"(^|/)(\.{1,2})$", "$1$2/"), "/")
    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    resolved = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), resolved).otherwise(path)


def absolutize_url(c: Column, base: str) -> Column:
    """Resolve a link against ``base``, dot segments too; blank stays blank."""
    at = urlsplit(base)
    origin, folder = f"{at.scheme}://{at.netloc}", at.path.rpartition("/")[0] + "/"

    def resolve(link: Column) -> Column:
        path, suffix = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"(?s)[?#].*$", 0)
        relative = F.concat(F.lit(folder), F.regexp_replace(path, "/{2,}", "/"))
        return (
            F.when(link == "", F.lit(""))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
            .when(link.startswith("//"), F.concat(F.lit(at.scheme + ":"), link))
            .when(link.startswith("/"), F.concat(F.lit(origin), let(path, _without_dots), suffix))
            .when(link.rlike(r"^[?#]"), F.concat(F.lit(base), link))
            .otherwise(F.concat(F.lit(origin), let(relative, _without_dots), suffix))
        )

    return let(F.coalesce(c, F.lit("")), resolve)


def url_record_id(url: Column, pattern: str = r"/event/.+?/(\d+)/?$") -> Column:
    """Digits captured by ``pattern`` in the path of the URL, else blank."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.regexp_extract(path, pattern, 1)


def _pair(number: Column, finder: Column) -> Column:
    return F.struct(number.alias("number"), finder.alias("finder"))


def _split_squashed(text: Column) -> Column:
    def group(pattern: str, index: int) -> Column:
        return F.regexp_extract(text, pattern, index)

    hash_finder = F.lower(group(FINDER_HASH_NUMBER, 1))
    tail_finder = F.lower(F.trim(group(FINDER_NUMBER, 1)))
    return (
        F.when(text == "", _pair(F.lit(""), F.lit("")))
        .when(
            text.rlike(NUMBER_FIRST),
            _pair(group(NUMBER_FIRST, 1), F.trim(F.regexp_replace(group(NUMBER_FIRST, 2), r"^[?\- ]+", ""))),
        )
        .when(
            text.rlike(FINDER_HASH_NUMBER) & ~hash_finder.contains("unclear"),
            _pair(group(FINDER_HASH_NUMBER, 2), F.trim(group(FINDER_HASH_NUMBER, 1))),
        )
        .when(
            text.rlike(FINDER_NUMBER) & ~tail_finder.rlike("^(number |no number)") & ~tail_finder.contains("unclear"),
            _pair(group(FINDER_NUMBER, 2), F.trim(group(FINDER_NUMBER, 1))),
        )
        .when(text.rlike(WORD_NUMBER), _pair(group(WORD_NUMBER, 1), F.trim(group(WORD_NUMBER, 2))))
        .otherwise(_pair(F.lit(""), text))
    )


def split_number_title(title: Column) -> Column:
    """Title -> struct(number, finder); the first matching shape wins."""
    return let(squash_text(title), _split_squashed)


def compose_title(number: Column, finder: Column, fallback: Column) -> Column:
    """"number finder", unless the fallback title already says exactly that."""

    def choose(parts: Column) -> Column:
        same_number = (parts["fallback"] != "") & (parts["parsed"]["number"] == parts["number"])
        return (
            F.when(parts["number"] == "", parts["fallback"])
            .when(parts["finder"] == "", F.when(same_number, parts["fallback"]).otherwise(parts["number"]))
            .when(same_number & (parts["parsed"]["finder"] == parts["finder"]), parts["fallback"])
            .otherwise(F.concat_ws(" ", parts["number"], parts["finder"]))
        )

    squeezed = collapse_spaces(F.coalesce(fallback, F.lit("")))
    parts = F.struct(
        F.trim(F.coalesce(number, F.lit(""))).alias("number"),
        collapse_spaces(F.coalesce(finder, F.lit(""))).alias("finder"),
        squeezed.alias("fallback"),
        split_number_title(squeezed).alias("parsed"),
    )
    return let(parts, choose)


def parse_year(c: Column) -> Column:
    """All digits -> that number; else the first 20xx; else null."""
    value = F.trim(c)
    return F.when(value.rlike(r"^\d+$"), value.try_cast("int")).otherwise(
        F.nullif(F.regexp_extract(value, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")
    )


def normalize_number(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^#", ""))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")


def number_format_ok(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(NUMBER_FORMAT)


def url_is_valid(c: Column) -> Column:
    """Blank is fine; otherwise an http(s) scheme and a host are needed."""
    value = F.trim(F.coalesce(c, F.lit("")))
    return (value == "") | value.rlike(r"(?i)^https?://[^/?#\s]+")


def url_host(c: Column) -> Column:
    """Lower-case host without a leading ``www.``; null when there is none."""
    host = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def infer_source(source: Column, url: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(source), url_host(url), F.lit(default))


def is_placeholder(image: Column, token: str = PLACEHOLDER_TOKEN) -> Column:
    return F.coalesce(image, F.lit("")).contains(token)


def is_blocked_page(html: Column) -> Column:
    return F.lower(F.coalesce(html, F.lit(""))).contains(BLOCKED_TOKEN)


def record_complete(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.trim(F.coalesce(c, F.lit(""))) != "" for c in columns])
