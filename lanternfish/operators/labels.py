"""Texts that contain patterns, for tables of patterns of any size, and what is built on it: labels and search.

Every pattern is filed under one anchor: the part of at most `WIDEST` characters that few patterns have. Texts are cut into
parts of the sizes that occur and meet the anchors in an equality join, so a text is compared with the patterns whose anchor
it has, never with all. Parts of sizes that few anchors have meet them where they are, only the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match as first_contained
from ..functions.text import let, squash_place
from ..schema import UNKNOWN_PLACE
from ..session import cut_lineage
from .archive import SEARCH_LIMIT

#: Longest part of a pattern that it can be filed under.
WIDEST = 8

#: Rows of the table that counts the patterns of a part, and the anchors of a size that are sent to all tasks, at most.
BINS, FEW = 1 << 20, 20_000

#: Rules that are tried one after another where the rows are, at most.
LISTED = 100

#: Texts that a task cuts into parts.
TEXTS_PER_TASK = 250_000

#: One text of so many is looked at for frequent parts.
SOME = 64

#: More than a pattern has characters.
STARTS = 1 << 31


def _parts(text: Column, size: Column) -> Column:
    """All parts of that many characters, each once."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def anchored(patterns: DataFrame) -> DataFrame:
    """Patterns, each once, with their anchor and the values of other columns; blank ones have none.

    Patterns that share a part are counted in a table of bounded size. Any part is a right anchor; a part that shares its bin
    with many others only looks more frequent than it is."""
    one = cut_lineage(patterns.where(F.col("pattern") != "").dropDuplicates(["pattern"]))
    size = F.least(F.length("pattern"), F.lit(WIDEST))
    starts = F.sequence(F.lit(1), F.length("pattern") - size + 1)
    parts = one.select("pattern", size.alias("size"), F.explode(starts).alias("start"))
    parts = parts.withColumn("bin", F.pmod(F.xxhash64(F.col("pattern").substr(F.col("start"), F.col("size"))), F.lit(BINS)))
    shared = parts.groupBy("bin").agg(F.count("*").alias("n"))
    # count and start in one number, which is compared without sorting
    rarest = F.min(F.col("n") * STARTS + F.col("start"))
    # the parts of a pattern are made in one task, so one row of a pattern is shuffled
    chosen = parts.join(F.broadcast(shared), "bin").groupBy("pattern").agg((rarest % STARTS).cast("int").alias("start"))
    return one.join(chosen, "pattern").select(*patterns.columns, F.col("pattern").substr(F.col("start"), size).alias("anchor"))


def _frequent(parts: DataFrame) -> DataFrame:
    """Parts of many texts, found in some of the texts: parts that are no anchors and would crowd one task are dropped before
    the shuffle. Which ones are found only matters for time."""
    some = parts.where(F.pmod(F.xxhash64("text"), F.lit(SOME)) == 0)
    counted = some.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return cut_lineage(counted.orderBy(F.col("n").desc(), "anchor").limit(FEW).select("anchor"))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, columns of patterns) for every text and every pattern that occurs in it; each pair once."""
    anchors = cut_lineage(anchored(patterns))
    known = texts.select("text").where(F.col("text").isNotNull())
    # texts compress so well that a shuffled partition of the usual size holds millions, each of many parts
    distinct = known.repartition(known.count() // TEXTS_PER_TASK + 1, "text").distinct()
    size = F.length("anchor")
    sizes = anchors.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()  # at most WIDEST rows

    def hits(some: list[int], wanted: DataFrame, shuffled: bool = False) -> DataFrame:
        listed = F.explode(F.array(*[F.lit(n) for n in some]).cast("array<int>")).alias("size")
        parts = distinct.select("text", listed).select("text", F.explode(_parts(F.col("text"), F.col("size"))).alias("anchor"))
        if shuffled and some:
            parts = parts.join(F.broadcast(_frequent(parts).join(wanted, "anchor", "left_anti")), "anchor", "left_anti")
        return parts.join(wanted, "anchor").where(F.contains("text", "pattern")).select("text", *patterns.columns)

    few, many = ([r["size"] for r in sizes if (r["n"] <= FEW) == yes] for yes in (True, False))
    return hits(few, F.broadcast(anchors.where(size.isin(few)))).unionByName(hits(many, anchors.where(size.isin(many)), True))


def first_match(rows: DataFrame, text: str, rules: DataFrame, out: str = "label", default: str = UNKNOWN_PLACE) -> DataFrame:
    """rows with `out`: the label of the first rule, by ``rule_order``, whose pattern occurs in the squashed place text.

    rules: (rule_order, pattern, label), patterns in squashed form. Rules with one order: the smaller pattern, then label.
    Blank texts and those without a rule get the default."""
    listed = rules.select("rule_order", "pattern", "label").where("pattern <> ''").limit(LISTED + 1).collect()
    if 0 < len(listed) <= LISTED:
        ordered = [(r["pattern"], r["label"]) for r in sorted(listed, key=lambda r: [(v is not None, v) for v in r])]
        label = let(squash_place(F.col(text)), lambda t: F.coalesce(first_contained(t, ordered), F.lit(default)))
        return rows.select(*rows.columns, label.alias(out))
    squashed = cut_lineage(rows.select(F.col(text).alias("raw")).distinct().select("raw", squash_place(F.col("raw")).alias("text")))
    first = rules.groupBy("pattern").agg(F.min(F.struct("rule_order", "label")).alias("rule"))
    found = containing(squashed, first).select("text", F.struct("rule.rule_order", "pattern", "rule.label").alias("rule"))
    best = found.groupBy("text").agg(F.min("rule").alias("b")).select("text", F.col("b.label").alias("found"))
    labelled = squashed.join(best, "text").select(F.col("raw").alias("raw_"), F.col("found").alias("found_"))
    joined = rows.join(labelled, F.col(text) == F.col("raw_"), "left")
    return joined.select(*rows.columns, F.coalesce("found_", F.lit(default)).alias(out))


def search(
    rows: DataFrame, searches: DataFrame, rules: DataFrame, fields: list[str], raw: str, key: str, order: list[str], limit: int = SEARCH_LIMIT
) -> DataFrame:
    """The newest ``limit`` rows for each of many search texts, answered together.

    searches: (search), distinct texts. A row is found if the text, whatever its case, is part of one of its fields or of the
    label of its place, or if the rules give the text and the row's place ``raw`` the same label; a `#` in a text asks for a
    number, so labels aren't compared then. order: columns, greatest first. Result: search, rank and the columns of rows."""
    asked = searches.select("search", F.trim("search").alias("shown"), F.lower(F.trim("search")).alias("pattern")).where("pattern <> ''")
    asked = cut_lineage(first_match(asked, "shown", rules, "asked_label"))
    labelled = cut_lineage(first_match(rows, raw, rules, "row_label"))
    lowered = F.array_distinct(F.array_compact(F.array(*[F.lower(F.col(f).cast("string")) for f in [*fields, "row_label"]])))
    said = labelled.select(key, F.explode(lowered).alias("text"))
    found = containing(said, asked.select("pattern")).join(said, "text").select("pattern", key)
    by_text = asked.select("search", "pattern").join(found, "pattern").select("search", key)
    known = asked.where(~F.col("search").contains("#") & (F.col("asked_label") != UNKNOWN_PLACE))
    by_label = known.join(labelled.select(key, F.col("row_label").alias("asked_label")), "asked_label").select("search", key)
    hits = by_text.unionByName(by_label).distinct().join(rows, key)
    rank = F.row_number().over(Window.partitionBy("search").orderBy(*[F.col(c).desc() for c in order]))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("search", "rank", *rows.columns)
