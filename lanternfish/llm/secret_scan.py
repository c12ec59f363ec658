"""Secrets in texts: known shapes, and strings that are too random for words.

Candidate strings are long runs of key characters. Their class (hex, lower-case with digits, mixed) sets how random a
window must be: the Shannon entropy of a sliding window is kept up to date from character counts, one character enters
and one leaves at each step, and only the counts of these two are looked at. Long candidates are cut into pieces that
overlap by a window less one character, and matches are placed in batches, so the work grows with the length of a text.
Candidates on the allow-list (words, paths of words, UUIDs, counting sequences, single
characters repeated) are suppressed, and so are those that a known shape covers already. The added span reaches from the
first to the last window above the threshold.

Entropy is summed in integers (count * log2(count) scaled and rounded), so a window's value doesn't depend on its past.
Spans are in code points, end exclusive. Defined cases: a null text counts as empty; texts without findings have counts
of 0 and an empty list; repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


@dataclass(frozen=True)
class Shape:
    """A known shape: the pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int
    least: int


# The shapes to be found.
SHAPES = (
    Shape("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Shape("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a run of 32 or more is found from its first character, shorter runs would be dropped
    Shape("hex", r"[0-9a-f]{32,}", 0, 32),
)

ENTROPY = "entropy"
KINDS = (*[s.kind for s in SHAPES], ENTROPY)

WINDOW = 24
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW

#: Class by pattern, in order, and the least entropy of a window in bits.
CLASSES = (("hex", "^[0-9A-Fa-f]+$", 3.0), ("lower", "^[a-z0-9]+$", 3.6), ("upper", "^[A-Z0-9]+$", 3.6), ("mixed", "", 4.0))

#: Candidates that are no secrets.
ALLOWED = (
    r"^[-A-Za-z+/_=]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"0123456789|(?i:abcdefghij|example|placeholder|xxxxxx)|(.)\1{7}",
)

SCALE = 1 << 20

#: Characters of a candidate's piece, and matches placed before their spans are joined to those before them.
PIECE = 128
BATCH = 256


def _weight(count: int) -> int:
    """count * log2(count), scaled."""
    return round(SCALE * count * math.log2(count)) if count else 0


def _limit(bits: float, window: int) -> int:
    """A window of `window` characters has at least so many bits if its summed weights are at most this."""
    return math.floor(SCALE * window * (math.log2(window) - bits))


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, found) of leftmost matches that do not overlap, without those whose group is too short.

    The pieces between matches and the matches themselves alternate, so their lengths give the places.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), group).alias("key"),
    )

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def place(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        good = F.coalesce(F.length(x["key"]) >= least, F.lit(False))
        return F.struct(
            F.coalesce(end, start).alias("at"), F.when(good, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans")
        )

    def place_batch(all_pairs: Column) -> Callable[[Column, Column], Column]:
        def step(a: Column, k: Column) -> Column:
            batch = F.aggregate(F.slice(all_pairs, k * BATCH + 1, BATCH), F.struct(a["at"].alias("at"), none.alias("spans")), place)
            return let(batch, lambda x: F.struct(x["at"].alias("at"), F.concat(a["spans"], x["spans"]).alias("spans")))

        return step

    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    batches = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / BATCH).cast("int"))
    placed = let(pairs, lambda ps: F.aggregate(batches(F.size(ps)), zero, place_batch(ps), lambda a: a["spans"]))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Array of (start, end) of the random parts of candidate strings."""
    gains = F.array(*[F.lit(_weight(c + 1) - _weight(c)).cast("long") for c in range(window + 1)])
    limits = [(pattern, _limit(bits, window)) for _, pattern, bits in CLASSES]

    def weight_of(text: Column, character: Column) -> Column:
        """What one more of a character weighs beside those in a text."""
        return F.get(gains, F.length(text) - F.length(F.replace(text, character, F.lit(""))))

    def high_part(piece: Column, limit: Column) -> Column:
        """(first, last): start of the first and end of the last window of a piece above the threshold, or nulls."""

        def step(a: Column, i: Column) -> Column:
            kept = F.substring(piece, F.greatest(i - (window - 1), F.lit(0)) + 1, F.least(i, F.lit(window - 1)))

            def changed(kept: Column) -> Column:
                lost = F.when(i >= window, weight_of(kept, F.substring(piece, i - window + 1, F.lit(1)))).otherwise(F.lit(0))
                return (a["total"] - lost + weight_of(kept, F.substring(piece, i + 1, F.lit(1)))).cast("long")

            def moved(total: Column) -> Column:
                high = (i >= window - 1) & (total <= limit)
                return F.struct(
                    total.alias("total"),
                    F.when(high & a["first"].isNull(), i - (window - 1)).otherwise(a["first"]).alias("first"),
                    F.when(high, i + 1).otherwise(a["last"]).alias("last"),
                )

            return let(let(kept, changed), moved)

        nothing = F.lit(None).cast("int")
        zero = F.struct(F.lit(0).cast("long").alias("total"), nothing.alias("first"), nothing.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.length(piece) - 1), zero, step)

    def random_part(span: Column) -> Column:
        found = span["found"]
        limit = F.lit(limits[-1][1])
        for pattern, value in reversed(limits[:-1]):
            limit = F.when(found.rlike(pattern), F.lit(value)).otherwise(limit)
        chunks = F.regexp_extract_all(found, F.lit(".{1,%d}" % max(PIECE, window)), F.lit(0))

        def high_of_chunk(all_chunks: Column, limit: Column) -> Callable[[Column, Column], Column]:
            def of(chunk: Column, k: Column) -> Column:
                before = F.when(k > 0, F.right(F.get(all_chunks, k - 1), F.lit(window - 1))).otherwise(F.lit(""))
                at = span["start"] + k * max(PIECE, window) - F.length(before)
                return let(
                    high_part(F.concat(before, chunk), limit),
                    lambda x: F.struct((at + x["first"]).alias("first"), (at + x["last"]).alias("last")),
                )

            return of

        highs = let(limit, lambda bound: let(chunks, lambda cs: F.transform(cs, high_of_chunk(cs, bound))))
        return let(highs, lambda hs: F.struct(F.array_min(hs["first"]).alias("start"), F.array_max(hs["last"]).alias("end")))

    allowed = lambda x: F.exists(F.array(*[x["found"].rlike(p) for p in ALLOWED]), lambda y: y)
    candidates = F.filter(_matches(text, CANDIDATE, 0, window), lambda x: ~allowed(x))
    return F.filter(F.transform(candidates, random_part), lambda x: x["start"].isNotNull())


def _ordered(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, n_entropy, spans): one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.select("doc_id", "text", *[_matches(F.col("text"), s.pattern, s.group, s.least).alias(s.kind) for s in SHAPES])
    ranked = lambda c, rank: F.transform(
        c, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))
    )
    df = df.select(
        "doc_id",
        "text",
        *[F.size(s.kind).cast("long").alias(f"n_{s.kind}") for s in SHAPES],
        F.concat(*[ranked(F.col(s.kind), i) for i, s in enumerate(SHAPES)]).alias("base"),
    )
    df = df.withColumn("random", entropy_spans(F.col("text"), window))
    covered = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    df = df.withColumn("added", F.filter("random", lambda x: ~covered(x)))
    return df.select(
        "doc_id",
        *[f"n_{s.kind}" for s in SHAPES],
        F.sha2(_ordered(F.col("base")), 256).alias("base_sha256"),
        F.size("added").cast("long").alias("n_entropy"),
        _ordered(F.concat(F.col("base"), ranked(F.col("added"), len(SHAPES)))).alias("spans"),
    )
