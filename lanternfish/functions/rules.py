"""Ordered keyword rules: the first declared rule whose pattern occurs in the text wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN_PLACE
from .text import let, squash_place

# Zone tag keywords.
WATERFRONT = (
    "beach",
    "bluff",
    "bluffs",
    "cove",
    "dock",
    "harbor",
    "harbour",
    "lighthouse",
    "marina",
    "ocean",
    "pond",
    "point",
    "salt",
    "shore",
)
TRAIL = (
    "farm",
    "forest",
    "greenway",
    "hollow",
    "hill",
    "labyrinth",
    "loop",
    "maze",
    "park",
    "preserve",
    "road",
    "trail",
)
TOWN = (
    "airport",
    "bagel",
    "hotel",
    "inn",
    "landing",
    "library",
    "market",
    "office",
    "school",
    "shop",
    "station",
    "street",
    "theater",
    "town",
)
ZONE_TAGS = {"waterfront": WATERFRONT, "trail": TRAIL, "town": TOWN}

# Condition buckets in the order they are tried, and severe-weather words.
CONDITIONS = (
    ("sunny", "\u2600\ufe0f"),
    ("clear", "\u2600\ufe0f"),
    ("partly cloudy", "\u26c5"),
    ("cloudy", "\u2601\ufe0f"),
    ("overcast", "\u2601\ufe0f"),
    ("rain", "\u2614"),
    ("drizzle", "\u2614"),
    ("shower", "\u2614"),
    ("thunder", "\u26c8\ufe0f"),
    ("storm", "\u26c8\ufe0f"),
    ("snow", "\u2744\ufe0f"),
    ("fog", "\U0001f32b\ufe0f"),
    ("mist", "\U0001f32b\ufe0f"),
    ("wind", "\U0001f4a8"),
)
DEFAULT_CONDITION = "\U0001f321\ufe0f"
SEVERE_WORDS = ("thunder", "storm", "gale", "snow", "advisory", "warning")

Rules = Sequence[tuple[str, str]]


def first_match(text: Column, rules: Rules, default: Column | None = None) -> Column:
    """Label of the first rule contained in ``text`` (already squashed); ``default`` or null otherwise.

    For the few rules that stand in a program. Dictionaries are tables: ``operators.labels.first_match``.
    """
    chain = F.when(text.contains(rules[0][0]), F.lit(rules[0][1]))
    for pattern, label in rules[1:]:
        chain = chain.when(text.contains(pattern), F.lit(label))
    return chain if default is None else chain.otherwise(default)


def place_label(raw: Column, rules: Rules, default: str = UNKNOWN_PLACE) -> Column:
    """Free-text place -> label; blank or unmatched texts get the default."""

    def label(text: Column) -> Column:
        return F.when(text == "", F.lit(default)).otherwise(first_match(text, rules, F.lit(default)))

    # the squashed text is tested against every rule: it is bound once, not once per branch
    return let(squash_place(raw), label)


def gated_label(
    raw: Column,
    gates: Sequence[str],
    number_pattern: str,
    numbered: dict[str, str],
    anchors: Rules,
    rules: Rules,
    default: str = UNKNOWN_PLACE,
) -> Column:
    """Numbered references and anchors apply only behind a gate token; then the general rules."""
    lookup = F.create_map(*[F.lit(x) for pair in numbered.items() for x in pair])

    def label(text: Column) -> Column:
        number = F.regexp_extract(text, number_pattern, 1)
        specific = F.when(
            text.rlike("|".join(gates)), F.coalesce(F.try_element_at(lookup, number), first_match(text, anchors))
        )
        return F.when(text == "", F.lit(default)).otherwise(
            F.coalesce(specific, first_match(text, rules, F.lit(default)))
        )

    return let(squash_place(raw), label)


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    return F.lower(text).rlike("|".join(keywords))


def tag_list(flags: dict[str, Column], default: str = "mixed") -> Column:
    """Array of the tags whose flag is set, in declared order; the default when none is."""
    tags = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in flags.items()]), lambda t: t.isNotNull())
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(default)))


def condition_bucket(text: Column, rules: Rules = CONDITIONS, default: str = DEFAULT_CONDITION) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda lowered: first_match(lowered, rules, F.lit(default)))


def condition_or_summary(condition: Column, summary: Column) -> Column:
    """Blank or "unknown" conditions are replaced by the summary; null when both are blank."""
    stated = F.trim(F.coalesce(condition, F.lit("")))
    return F.when((stated != "") & (F.lower(stated) != "unknown"), stated).otherwise(
        F.nullif(F.trim(F.coalesce(summary, F.lit(""))), F.lit(""))
    )


def is_severe(text: Column) -> Column:
    return any_keyword(F.coalesce(text, F.lit("")), SEVERE_WORDS)
