import random

from pyspark.sql import functions as F

from lanternfish.functions import rules
from lanternfish.operators import labels

RULES = (("harbor", "Harbor"), ("new harbor", "New Harbor"), ("hill", "Hill Road"))


def test_first_declared_rule_wins(column):
    label = lambda c: rules.place_label(c, RULES)
    assert column(label, ["New HARBOR dock", "up the hill", "", None, "elsewhere"]) == [
        "Harbor", "Hill Road", "Other/Unknown", "Other/Unknown", "Other/Unknown",
    ]


def test_rule_tables_of_any_size(spark):
    """Against a plain loop: patterns inside words, over several words, within each other, of one letter, with equal orders."""
    rng = random.Random(8)
    words = ["rod", "road", "new", "harbor", "pier", "a", "hill", "old mill", "mill road"]
    table = [(k % 150, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 12))).strip() or "zz", f"L{k}") for k in range(300)]
    table += [(150 + k, w, w.title()) for k, w in enumerate(words)] + [(7, "", "blank")]
    texts = [" ".join(rng.choice(words + ["abcd", "efgh", "xx", "q"]) for _ in range(rng.randrange(0, 5))) for _ in range(120)] + [None, "", "Old   MILL-road"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, place string")
    rule_table = spark.createDataFrame(table, "rule_order int, pattern string, label string")
    got = {r["id"]: r["label"] for r in labels.first_match(rows, "place", rule_table).collect()}
    for k, text in enumerate(texts):
        squashed = " ".join((text or "").lower().replace("-", " ").split())
        fits = sorted((o, p, v) for o, p, v in table if p and p in squashed)
        assert got[k] == (fits[0][2] if fits else "Other/Unknown"), text


def test_many_rules_cost_a_text_only_those_of_its_anchor(spark):
    rule_table = spark.range(50_000).select((-F.col("id")).alias("rule_order"), F.concat(F.lit("stop "), F.col("id")).alias("pattern"), F.concat(F.lit("S"), F.col("id")).alias("label"))
    rows = spark.createDataFrame([("Stop 123",), ("at stop 49999!",), ("bus stop",)], "place string")
    assert {r["place"]: r["label"] for r in labels.first_match(rows, "place", rule_table).collect()} == {
        "Stop 123": "S123", "at stop 49999!": "S49999", "bus stop": "Other/Unknown"
    }
    assert labels.anchored(rule_table).groupBy("anchor").count().agg(F.max("count")).first()[0] <= 11


def test_parts_that_are_no_anchor_are_dropped_before_the_shuffle(spark, monkeypatch):
    """Texts share long parts that no pattern is filed under; patterns of few and of many sizes, dealt to several tasks."""
    monkeypatch.setattr(labels, "FEW", 100)
    monkeypatch.setattr(labels, "SOME", 2)
    monkeypatch.setattr(labels, "TEXTS_PER_TASK", 300)
    rule_table = spark.range(2000).select((-F.col("id")).alias("rule_order"), F.concat(F.lit("lot "), F.col("id")).alias("pattern"), F.col("id").cast("string").alias("label"))
    rows = spark.range(0, 4000, 2).select(F.concat(F.lit("everywhere the lot "), F.col("id"), F.lit(" sold")).alias("place"))
    got = {r["place"]: r["label"] for r in labels.first_match(rows, "place", rule_table).collect()}
    assert got == {f"everywhere the lot {n} sold": max((str(n)[:k] for k in range(1, 5) if int(str(n)[:k]) < 2000), key=int) for n in range(0, 4000, 2)}
    parts = rows.select(F.col("place").alias("text"), F.explode(labels._parts(F.col("place"), F.lit(8))).alias("anchor"))
    assert {"everywhe", "the lot "} <= {r["anchor"] for r in labels._frequent(parts).collect()}


def test_search_many_texts_at_once(spark):
    rows = spark.createDataFrame(
        [(1, 2024, "Ann", "the new harbor", "12"), (2, 2025, "Bob", "harbour", "7"), (3, 2023, "Cid", "hill", "112"), (4, 2025, None, None, None)],
        "id int, year int, finder string, place string, number string",
    )
    rule_table = spark.createDataFrame([(1, "harbo", "Harbor"), (2, "hill", "Hill Road")], "rule_order int, pattern string, label string")
    asked = spark.createDataFrame([(x,) for x in ("HARBOR ", "hill road", "12", "#12", "bob", "", "harbour #", "ROAD")], "search string")
    found = labels.search(rows, asked, rule_table, ["finder", "place", "number"], "place", "id", ["year", "id"])
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["search"], r["rank"])):
        got.setdefault(r["search"], []).append(r["id"])
    assert got == {"HARBOR ": [2, 1], "hill road": [3], "12": [1, 3], "bob": [2], "ROAD": [3]}


def test_gated(column):
    numbered = {str(n): f"Stop {n}" for n in range(1, 12)}
    label = lambda c: rules.gated_label(
        c, ("greenpath", "green path"), r"\bgreen\s*path\s*(?:trail)?\s*#\s*(\d{1,2})\b", numbered, (("hollow", "The Hollow"),), RULES
    )
    assert column(label, ["Greenpath #3", "green path trail # 11", "greenpath #12", "greenpath hollow", "hollow", "greenpath hill"]) == [
        "Stop 3", "Stop 11", "Other/Unknown", "The Hollow", "Other/Unknown", "Hill Road",
    ]


def test_conditions(column):
    assert column(rules.condition_bucket, ["Mostly Sunny", "Partly Cloudy", "Light rain", "odd"]) == [
        "☀️", "⛅", "☔", "\U0001f321️",
    ]
    assert column(rules.is_severe, ["Gale warning", "calm"]) == [True, False]
    assert column(lambda c: rules.condition_or_summary(c, F.lit(" Breezy ")), ["Unknown", "", "Fog"]) == ["Breezy", "Breezy", "Fog"]
