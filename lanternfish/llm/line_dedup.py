"""Removal of repeated line chunks with content-defined boundaries.

A text is cut into chunks of lines. A rolling hash over the hashes of the last two lines decides where a chunk ends, so
the cuts move with the lines when something is inserted above them. A line of `LONG_LINE` words or more is a chunk of its
own, another content-defined cut, since passages here often are one line. Chunks of two or more lines with a word, and
long lines, are compared across the whole table.

Cuts seldom coincide with the ends of a passage. So each two adjacent lines with a word (and the blank ones between) are
compared likewise, and pairs that follow each other here and at one earlier place make a run, which goes if it has
`RUN_WORDS` words or more. The earlier place of a pair is the one before it in its own document, else the first one in the
table, in the order of doc_id, hash of the text, and line.

Hashes only say what to compare: the lines of a chunk or run are fetched from its earlier place and go where they are equal
to it byte by byte. What goes has an equal line at an earlier place, so every line is left somewhere. Texts meet twice,
those with earlier places and those that may lose something; all others stay where they are.

Defined cases: a null text stays null and an empty one empty; documents may end up with an empty text, their rows stay;
rows with the same doc_id and text keep or lose the same lines; a null doc_id is ordered last; an empty table gives an
empty result; other columns pass through, `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LAST_ID, packed, with_text, words_of

#: A cut after every line whose rolling hash ends in so many zero bits: 2 gives four lines a chunk on average.
CUT_BITS = 2
#: Lines of so many words are chunks of their own.
LONG_LINE = 40
#: Runs of repeated adjacent lines with so many words go.
RUN_WORDS = 50
#: Up to so many names of documents (16 bytes each) are handed to all tasks; more are brought together by shuffles.
FEW_NAMES = 2_000_000

HAS_WORD = r"[^\x20\x09-\x0D]"


def _is_long(line: Column, long_line: int) -> Column:
    # so many words need at least so many characters; few lines are split
    return (F.length(line) >= 2 * long_line - 1) & (F.size(words_of(line)) >= long_line)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("doc.text")
    keyed = packed(docs).select(
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *more
    )
    return keyed.withColumn("name", F.xxhash64("id", "text_hash"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def units(docs: DataFrame, cut_bits: int = CUT_BITS, long_line: int = LONG_LINE) -> DataFrame:
    """(id, text_hash, h, pair, line, n): hash, first line and number of lines of all chunks that count and of all pairs of
    adjacent lines with a word; pair: number of the pair in its text, null for chunks."""
    one = lambda x: F.struct(_hash(x).alias("h"), _is_long(x, long_line).alias("long"), x.rlike(HAS_WORD).alias("filled"))
    df = _keyed(docs).select("id", "text_hash", F.transform(_lines(F.col("text")), one).alias("facts"))
    rolled = lambda h: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
    before = lambda i: F.coalesce(F.get("facts", i - 1)["h"], F.lit(0).cast("long"))
    ends_here = lambda x, i: (
        x["long"]
        | F.coalesce(F.get("facts", i + 1)["long"], F.lit(True))
        | (rolled(before(i)).bitwiseXOR(x["h"]).bitwiseAND(F.lit((1 << cut_bits) - 1)) == 0)
    )
    df = df.withColumn("ends", F.array_compact(F.transform("facts", lambda x, i: F.when(ends_here(x, i), i))))
    df = df.withColumn("filled", F.array_compact(F.transform("facts", lambda x, i: F.when(x["filled"], i))))

    def chunk(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))
        part = F.slice("facts", first + 1, end - first + 1)
        counts = (F.size(F.filter(part, lambda x: x["filled"])) >= 2) | F.exists(part, lambda x: x["long"])
        unit = F.struct(F.xxhash64(F.transform(part, lambda x: x["h"])).alias("h"), F.lit(None).cast("int").alias("pair"), first.alias("line"), (end - first + 1).alias("n"))
        return F.when(counts, unit)

    def pair(line: Column, q: Column) -> Column:
        after = F.get("filled", q + 1)
        # another number of values than a chunk's hash
        h = F.xxhash64(F.get("facts", line)["h"], F.get("facts", after)["h"], after - line)
        return F.struct(h.alias("h"), q.alias("pair"), line.alias("line"), (after - line + 1).alias("n"))

    pairs = F.transform(F.slice("filled", 1, F.greatest(F.size("filled") - 1, F.lit(0))), pair)
    found = F.concat(F.array_compact(F.transform("ends", chunk)), pairs)
    return df.select("id", "text_hash", F.explode(found).alias("u")).select("id", "text_hash", "u.*")


def repeats(docs: DataFrame, cut_bits: int = CUT_BITS, long_line: int = LONG_LINE) -> DataFrame:
    """(id, text_hash, run, line, n, e_id, e_text_hash, e_line): lines that may be equal to those of one earlier place, by
    their hashes; run: whether they are pairs in a row, which need enough words."""
    seen = cut_lineage(units(docs, cut_bits, long_line))
    several = seen.groupBy("h").agg(F.min("id").alias("e_id"), F.count("*").alias("n")).where("n > 1").select("h", "e_id")
    suspects = cut_lineage(seen.join(several, "h"))
    # few rows from here on, none of them wide
    first = suspects.where("id = e_id").groupBy("h").agg(F.min(F.struct("text_hash", "line", "pair")).alias("e"))
    first = cut_lineage(first.select("h", F.col("e.text_hash").alias("e_text_hash"), F.col("e.line").alias("e_line"), F.col("e.pair").alias("e_pair")))
    placed = suspects.distinct().join(first, "h")
    own = Window.partitionBy("id", "text_hash", "h").orderBy("line")
    placed = placed.withColumn("own_line", F.lag("line").over(own)).withColumn("own_pair", F.lag("pair").over(own))
    here = F.col("own_line").isNotNull()
    earlier = placed.select(
        "id", "text_hash", "pair", "line", "n",
        F.when(here, F.col("id")).otherwise(F.col("e_id")).alias("e_id"),
        F.when(here, F.col("text_hash")).otherwise(F.col("e_text_hash")).alias("e_text_hash"),
        F.when(here, F.col("own_line")).otherwise(F.col("e_line")).alias("e_line"),
        F.when(here, F.col("own_pair")).otherwise(F.col("e_pair")).alias("e_pair"),
    ).where("id <> e_id or text_hash <> e_text_hash or line <> e_line")
    earlier = cut_lineage(earlier)
    chunks = earlier.where("pair is null").select("id", "text_hash", F.lit(False).alias("run"), "line", "n", "e_id", "e_text_hash", "e_line")

    # pairs in a row, here and there; those of one text are no more than its lines
    links = F.array_sort(F.collect_list(F.struct("pair", "line", "n", "e_id", "e_text_hash", "e_line", "e_pair"))).alias("links")
    of_text = earlier.where("pair is not null").groupBy("id", "text_hash").agg(links)
    follows = lambda b, a: (
        (b["pair"] == a["pair"] + 1) & (b["e_pair"] == a["e_pair"] + 1) & (b["e_id"] == a["e_id"]) & (b["e_text_hash"] == a["e_text_hash"])
    )
    starts = F.filter("links", lambda x, i: ~F.coalesce(follows(x, F.get("links", i - 1)), F.lit(False)))
    ends = F.filter("links", lambda x, i: ~F.coalesce(follows(F.get("links", i + 1), x), F.lit(False)))
    of_text = of_text.select("id", "text_hash", starts.alias("starts"), ends.alias("ends"))
    run = F.zip_with("starts", "ends", lambda a, b: F.struct(
        F.lit(True).alias("run"), a["line"].alias("line"), (b["line"] + b["n"] - a["line"]).alias("n"),
        a["e_id"].alias("e_id"), a["e_text_hash"].alias("e_text_hash"), a["e_line"].alias("e_line"),
    ))
    runs = of_text.select("id", "text_hash", F.explode(run).alias("r")).select("id", "text_hash", "r.*")
    return chunks.unionByName(runs)


def _named(docs: DataFrame, names: DataFrame, few: bool, how: str) -> DataFrame:
    """Rows of docs whose name is (left_semi) or isn't (left_anti) among few names; without few names all or none."""
    if few:
        return docs.join(F.broadcast(names), "name", how)
    return docs if how == "left_semi" else docs.where("false")


def _deduplicated(docs: DataFrame, cut_bits: int, long_line: int) -> DataFrame:
    """`doc` with `clean` and `n_gone` (lines that went)."""
    wanted = cut_lineage(repeats(docs, cut_bits, long_line))
    name = lambda *of: F.xxhash64(*of).alias("name")
    givers = cut_lineage(wanted.select(name("e_id", "e_text_hash")).distinct())
    losers = cut_lineage(wanted.select(name("id", "text_hash")).distinct())
    few_givers, few_losers = givers.count() <= FEW_NAMES, losers.count() <= FEW_NAMES

    # lines of the earlier places, brought to the texts that may lose them
    asked = wanted.groupBy("e_id", "e_text_hash").agg(F.collect_set(F.struct("e_line", "n")).alias("asked"))
    asked = asked.withColumnsRenamed({"e_id": "id", "e_text_hash": "text_hash"})
    giving = _named(_keyed(docs), givers, few_givers, "left_semi").select("id", "text_hash", "text")
    giving = giving.join(asked, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    giving = giving.select("id", "text_hash", _lines(F.col("text")).alias("lines"), F.explode("asked").alias("a"))
    there = giving.select(
        F.col("id").alias("e_id"), F.col("text_hash").alias("e_text_hash"), F.col("a.e_line").alias("e_line"), F.col("a.n").alias("n"),
        F.array_join(F.slice("lines", F.col("a.e_line") + 1, F.col("a.n")), "\n").alias("bytes"),
    )
    brought = wanted.join(there, ["e_id", "e_text_hash", "e_line", "n"])
    brought = brought.groupBy("id", "text_hash").agg(F.collect_list(F.struct("run", "line", "n", "bytes")).alias("brought"))

    keyed = _keyed(docs, "doc")
    losing = _named(keyed, losers, few_losers, "left_semi").join(brought, ["id", "text_hash"], "left")
    losing = losing.withColumn("lines", F.when(F.col("brought").isNotNull(), _lines(F.col("text"))))
    mine = lambda x: F.array_join(F.slice("lines", x["line"] + 1, x["n"]), "\n")
    equal = F.filter("brought", lambda x: (mine(x) == x["bytes"]) & (~x["run"] | (F.size(words_of(x["bytes"])) >= RUN_WORDS)))
    losing = losing.withColumn("gone", F.flatten(F.transform(equal, lambda x: F.sequence(x["line"], x["line"] + x["n"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    losing = losing.withColumn("left", F.when(F.size("gone") > 0, left))
    changed = losing.select(
        "doc",
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")).alias("clean"),
        F.coalesce(F.when(F.col("left").isNotNull(), F.size("lines") - F.size("left")), F.lit(0)).cast("long").alias("n_gone"),
    )
    same = _named(keyed, losers, few_losers, "left_anti").select("doc", F.col("text").alias("clean"), F.lit(0).cast("long").alias("n_gone"))
    return changed.unionByName(same)


def dedup_lines(docs: DataFrame, cut_bits: int = CUT_BITS, long_line: int = LONG_LINE) -> DataFrame:
    """The documents with their columns, without the chunks that an earlier place in the table has already."""
    return _deduplicated(docs, cut_bits, long_line).select(*with_text(docs, F.col("clean")))


def report(docs: DataFrame, cut_bits: int = CUT_BITS, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, text, n_lines_removed): the whole cleaned texts."""
    return _deduplicated(docs, cut_bits, long_line).select("doc.doc_id", F.col("clean").alias("text"), F.col("n_gone").alias("n_lines_removed"))
