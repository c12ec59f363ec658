"""Mixing of sources to target weights by a low-discrepancy schedule.

Slots of equal length are dealt out by the golden-ratio sequence: the point of slot i, frac(i * phi), falls into the
share of one source. The r-th slot of a source takes the r-th block of that source, where the documents of a source, in
a shuffled order, form one line of words that is cut into equal blocks and is walked again when it ends. So every prefix
of the schedule is close to the targets, and the whole schedule meets them to within a block per source.

Defined cases: a null text has size 0; documents without words take nothing; a null source is a source of its own, last
in order; repeated rows are documents of their own (they share the place of their twins in the shuffled order, one
after the other); an empty table gives an empty mix. No document is taken more than three times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LAST_ID, count_words, packed, with_text

#: Words of a block and slot.
BLOCK = 1024
#: A source gives at most this many times its words.
MOST_TIMES = 3
#: Slots whose ranks are counted in one group.
CHUNK = 4096
#: Documents expected in one group of the shuffled order.
RUN = 400

PHI_FRACTION = (math.sqrt(5) - 1) / 2


def targets(sizes: DataFrame, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row per source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target above `most_times`
    of its source is cut there. Cut sources are those with the smallest size per weight, so one pass in that order
    finds them: with the sources before it cut, a source is cut if its share of the rest still exceeds its limit.
    """
    # one row per source: sorted by its UTF-8 bytes, which is the order of code points
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("weight", (F.lit(1) + (F.row_number().over(order) - 1) % 3).cast("double"))
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").isNull(), F.col("source"))
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    limit = most_times * F.col("source_size")
    rest = F.col("total") - most_times * F.col("size_before")
    share = rest * F.col("weight") / F.col("weight_left")
    marked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("cut", share >= limit)
    )
    # a source is cut only if all before it are; the first one that is not fixes the rate of all others
    last = F.min(F.when(~F.col("cut"), F.struct((F.col("source_size") / F.col("weight")).alias("need"), (rest / F.col("weight_left")).alias("rate"))))
    return (
        marked.withColumn("rate", last.over(everything)["rate"])
        .withColumn("target", F.when(F.col("rate").isNull(), limit).otherwise(F.least(limit.cast("double"), F.col("rate") * F.col("weight"))))
        .select("source", F.col("source_size"), "weight", F.col("target").cast("double").alias("target"))
    )


def _shuffled(docs: DataFrame, seed: int) -> DataFrame:
    """(source, doc, size) with `start`: where the document begins in the line of its source.

    The line is ordered by a hash. Its prefix sums come from two levels, sums of hash ranges and sums within a range, so
    no task sees a whole source.
    """
    n_docs = docs.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(2, n_docs / RUN))))
    # identity for the order: id and text, so that reruns agree whatever the partitions are
    keyed = docs.withColumn("h", F.xxhash64(F.lit(seed), "id", "text_hash")).withColumn("run", F.shiftrightunsigned("h", 64 - bits))
    sums = keyed.groupBy("source", "run").agg(F.sum("size").alias("in_run"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_run").over(before), F.lit(0))).drop("in_run")
    within = Window.partitionBy("source", "run").orderBy("h", "id", "text_hash")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("place", F.row_number().over(within))
    return _same_source(placed, offsets, "run").withColumn("start", F.col("offset") + F.col("inner")).drop("h", "run", "offset", "inner")


def _same_source(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on the source, null equal to null, and further keys."""
    r = right.select([F.col(c).alias(f"r_{c}" if c in ("source", *keys) else c) for c in right.columns])
    on = F.col("source").eqNullSafe(F.col("r_source"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return left.join(r, on, "left").drop("r_source", *[f"r_{k}" for k in keys])


def schedule(spark, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, turn): which source a slot belongs to and the how-manieth slot of that source it is, from 0.

    shares: (source, source_size, target), one row per source. Ranks come from counts per chunk of slots, so the slots
    of one source are never gathered in one task.
    """
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    spans = (
        shares.where(F.col("target") > 0)
        .withColumn("hi", F.sum("target").over(upto) / F.sum("target").over(everything))
        .withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
        .withColumn("hi", F.when(F.row_number().over(upto) == F.count("*").over(everything), F.lit(2.0)).otherwise(F.col("hi")))
        .select("source", "lo", "hi")
    )
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    slots = spark.range(math.ceil(total / block)).select(
        F.col("id").alias("slot"), (F.col("id") * F.lit(PHI_FRACTION) - F.floor(F.col("id") * F.lit(PHI_FRACTION))).alias("point")
    )
    # the spans are one row per source; the join is by range and they are sent to the slots only while Spark finds them small
    bins = 256
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))))
    dealt = (
        slots.withColumn("bin", F.floor(F.col("point") * bins))
        .join(spans, "bin")
        .where((F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi")))
        .select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rank = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = dealt.withColumn("inner", F.row_number().over(rank) - 1)
    return _same_source(ranked, offsets, "chunk").select("slot", "source", (F.col("offset") + F.col("inner")).alias("turn"))


def _identity(doc: str) -> list[Column]:
    """`id` and `text_hash`: never null, equal for repeated rows only."""
    source, text = F.col(f"{doc}.source"), F.col(f"{doc}.text")
    return [
        F.coalesce(F.col(f"{doc}.doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(source.isNull(), source, text.isNull(), text).alias("text_hash"),
    ]


def mix(docs: DataFrame, block: int = BLOCK, most_times: int = MOST_TIMES, seed: int = 11) -> DataFrame:
    """(doc_id, id, text_hash, source, size, source_size, target, start, place, taken): one row per document.

    `taken` counts the words of the document in all blocks that the schedule takes. A block is the words
    [turn * block, (turn + 1) * block) of the endless line of its source, and the line ends after `most_times` rounds.
    """
    spark = docs.sparkSession
    sized = cut_lineage(
        packed(docs).select("doc.doc_id", *_identity("doc"), "doc.source", count_words(F.col("doc.text")).alias("size"))
    )
    shares = cut_lineage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most_times))
    placed = _same_source(_shuffled(sized, seed), shares.drop("weight"))
    # A block that runs over the end of a round of its line has a piece in the next round.
    turns = _same_source(schedule(spark, shares, block), shares).where(F.col("source_size") > 0)
    whole = F.col("source_size")
    begin, end = F.col("turn") * block, F.least((F.col("turn") + 1) * block, whole * most_times)
    pieces = (
        turns.where(begin < end)
        .withColumn("round", F.explode(F.sequence(F.floor(begin / whole), F.floor((end - 1) / whole))))
        .withColumn("lo", F.greatest(begin - F.col("round") * whole, F.lit(0)))
        .withColumn("hi", F.least(end - F.col("round") * whole, whole))
    )
    # cells of block length bring pieces and documents together: a cell meets a few pieces and as many documents as it holds
    cells = lambda lo, hi: F.sequence(F.floor(lo / block), F.floor((hi - 1) / block))
    pieces = pieces.groupBy("source", "lo", "hi").agg(F.count("*").alias("times"))
    pieces = pieces.withColumn("cell", F.explode(cells(F.col("lo"), F.col("hi"))))
    a, b = F.col("start"), F.col("start") + F.col("size")
    spans = placed.withColumn("cell", F.explode_outer(F.when(F.col("size") > 0, cells(a, b))))
    left, right = F.col("cell") * block, (F.col("cell") + 1) * block
    overlap = F.least(F.col("hi"), b, right) - F.greatest(F.col("lo"), a, left)
    words = F.coalesce(F.greatest(overlap, F.lit(0)) * F.col("times"), F.lit(0))
    return (
        _same_source(spans, pieces, "cell")
        .groupBy("doc_id", "id", "text_hash", "source", "size", "source_size", "target", "start", "place")
        .agg(F.sum(words).cast("long").alias("taken"))
    )


def take(docs: DataFrame, block: int = BLOCK, most_times: int = MOST_TIMES, seed: int = 11) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for every whole time a document is taken and one for the
    words of a last, partial time. Those are the first words of the text with the blanks between them; only the
    documents at the end of the line of a source have such a row, but for blocks that the schedule leaves out.
    """
    nth = lambda order: F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(order))
    plan = mix(docs, block, most_times, seed).where(F.col("taken") > 0).withColumn("nth", nth(F.struct("start", "place"))).select("id", "text_hash", "nth", "size", "taken")
    rows = packed(docs).select("doc", *_identity("doc")).withColumn("nth", nth(F.lit(0)))
    joined = rows.join(plan, ["id", "text_hash", "nth"])
    part, times = F.col("taken") % F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    joined = joined.withColumn("first_words", F.explode(copies))
    # words and the blanks before them, taken up to the n-th word
    steps = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    text = F.when(F.col("first_words") == 0, F.col("doc.text")).otherwise(
        F.array_join(F.slice(steps, F.lit(1), F.col("first_words").cast("int")), "")
    )
    return joined.select(*with_text(docs, text))
