"""Quality rules as a short-circuit cascade.

A rule needs some facts of a text and says when the text fails. On a small sample every rule is timed and its
rejections are counted; the cascade then asks the rules in the order of rejections per cost. A fact is computed only
for texts that no earlier rule has rejected, so the costly facts are left to the texts that survive the cheap ones.
The verdict does not depend on the order, only the cost does.

Defined cases: a null text counts as empty and has no words; an empty text fails `few_words`; repeated rows are judged
one by one; an empty table gives an empty result; columns of the caller are never read besides `text`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import computed_once, packed, where_computed, words_of

#: Rows on which costs and rejections are estimated. They decide the order of the rules, never a verdict.
SAMPLE_ROWS = 400
#: Runs of which the shortest counts, and seconds below which costs can't be told apart.
REPEATS, LEAST_COST = 3, 0.001

SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """`fails` is an SQL condition over the facts named in `facts`."""

    name: str
    facts: tuple[str, ...]
    fails: str


BASE = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
)

MORE = (
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > 3 * n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "10 * n_dup_lines > 4 * n_lines"),
    Rule("shouting", ("word_chars", "n_marks"), "100 * n_marks > 8 * word_chars"),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def _plain(name: str, value: Callable[[], Column]) -> Callable[[DataFrame, Column], DataFrame]:
    return lambda df, alive: df.withColumn(name, F.when(alive, value()))


def _length_without(pattern: str) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _with_words(df: DataFrame, alive: Column) -> DataFrame:
    return df.withColumn("words", F.when(alive, words_of(F.col("text"))))


def _with_lines(df: DataFrame, alive: Column) -> DataFrame:
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumn("lines", F.when(alive, lines))


def _with_repeats(df: DataFrame, alive: Column) -> DataFrame:
    """Words that lie in a window of three words found twice or more in the text, each position once.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated window get past the first step;
    their windows are sorted by hash, so equal ones are neighbours, and the positions of those are merged.
    """
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(3)])
    df = df.withColumn(
        "windows", F.when(alive & (F.size("words") >= 3), F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    df = df.withColumn("ordered", F.when(repeated, F.sort_array(F.transform("windows", pair))))
    twin = lambda x, k: F.when(
        x["h"].eqNullSafe(F.get("ordered", k - 1)["h"]) | x["h"].eqNullSafe(F.get("ordered", k + 1)["h"]), x["i"]
    )
    df = df.withColumn("starts", F.sort_array(F.array_compact(F.transform("ordered", twin))))
    merge = lambda a, x: F.struct(
        (x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n")
    )
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), merge, lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.when(alive, F.coalesce(covered, F.lit(0)).cast("long"))).drop(
        "windows", "ordered", "starts"
    )


#: How a fact is made, and what it is made from.
FACTS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame, Column], DataFrame]]] = {
    "words": ((), _with_words),
    "lines": ((), _with_lines),
    "n_words": (("words",), _plain("n_words", lambda: F.size("words").cast("long"))),
    "word_chars": (("words",), _plain("word_chars", lambda: F.length(F.array_join("words", "")).cast("long"))),
    "n_symbols": ((), _plain("n_symbols", lambda: _length_without(SYMBOLS))),
    "n_marks": ((), _plain("n_marks", lambda: _length_without("[!?]+"))),
    "n_lines": (("lines",), _plain("n_lines", lambda: F.size("lines").cast("long"))),
    "n_dup_lines": (
        ("lines",),
        _plain("n_dup_lines", lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")),
    ),
    "n_repeat_words": (("words",), _with_repeats),
}


def with_facts(df: DataFrame, names: tuple[str, ...], alive: Column | None = None) -> DataFrame:
    """Add facts (and what they are made from) to a frame of `doc` and `text`; rows that are not alive get nulls."""
    for name in names:
        if name not in df.columns:
            needs, make = FACTS[name]
            df = make(with_facts(df, needs, alive), F.lit(True) if alive is None else alive)
    return df


def cascade(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add `rejected_by`: the first rule, in the given order, that a text fails; null if it passes all."""
    df = df.withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        alive = F.col("rejected_by").isNull()
        df = with_facts(df, rule.facts, alive)
        df = df.withColumn("rejected_by", F.when(alive & F.expr(rule.fails), F.lit(rule.name)).otherwise(F.col("rejected_by")))
    # every rule reads the verdict of those before it: a filter that is pushed below would repeat them all, many times over
    return computed_once(df, "rejected_by")


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Estimate]:
    """Time every rule on a sample and count what it rejects.

    A cost is what the rule's facts take beyond those in `known`, which the cascade has already: the shortest of `REPEATS`
    runs, less the shortest run of a job that computes nothing."""
    sample = cut_lineage(with_facts(docs.select("text").sample(0.2, seed=7).limit(sample_rows), known))

    def timed(fails: str, facts: tuple[str, ...]) -> tuple[float, float]:
        judged, took = with_facts(sample, facts).agg(F.count("*").alias("n"), F.count_if(F.expr(fails)).alias("bad")), []
        for _ in range(REPEATS):
            start = time.perf_counter()
            row = judged.first()
            took.append(time.perf_counter() - start)
        return min(took), row["bad"] / max(row["n"], 1)

    timed("true", ())  # the first job of a session isn't typical
    idle, _ = timed("true", ())
    found = []
    for rule in rules:
        cost, rejected = timed(rule.fails, rule.facts)
        found.append(Estimate(rule, max(cost - idle, LEAST_COST), rejected))
    return found


def ordered(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejections per cost, the most worthwhile first; ties in the declared order."""
    return [e.rule for e in sorted(estimate(docs, rules, sample_rows, known), key=lambda e: -e.worth)]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base facts of every document, `base_failed`, and `kept` after the cascade of further rules."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # words are split once: the columns below are made from the same array
    df = with_facts(packed(docs).select("doc", F.col("doc.text").alias("text")), base)
    failed = F.expr(" or ".join(f"({r.fails})" for r in BASE))
    df = df.withColumn("base_failed", failed)
    order = ordered(docs, rules, sample_rows, base)
    df = computed_once(df, *base, "base_failed")
    verdict = cascade(df.withColumn("text", F.when(~F.col("base_failed"), F.col("text"))), order)
    return verdict.select(
        "doc.doc_id", *base, "base_failed", "rejected_by", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, with all their columns."""
    df = packed(docs).select("doc", F.col("doc.text").alias("text"))
    judged = cascade(df, ordered(docs, rules, sample_rows))
    return where_computed(judged, F.col("rejected_by").isNull()).select("doc.*")
