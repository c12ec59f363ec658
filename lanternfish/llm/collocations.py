"""Frequent phrases that occur more often than their parts make likely, by multikey quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`. All is counted per
language. A suffix is what follows from a word on in its piece, five words at most. Two passes over the texts:
1. words and adjacent pairs are counted, per task first; keys go to parts by their hash. Pairs are counted by hash only,
   which never counts too few. Those that are frequent enough are marked in a bit table of bounded size.
2. a suffix ends where its next pair isn't marked. Equal suffixes of a task are counted there; pairs are routed to parts
   by their two words, longer suffixes by their three leading words, so every partition of equal leading words lies in one
   part. A part sorts its pointers by three-way multikey quicksort, to the last word; the weights of its equal partitions
   are the counts of phrases, and a partition of less weight than `least` is abandoned, whatever is in it.

Words are named by 64-bit hashes of language and word. Two frequent words of one name are noticed in the first pass, which
is repeated then with another seed. The bit table is wrong in the harmless direction only: with more pairs than it can tell
apart more suffixes are routed, the counts stay exact.

Defined cases: null texts are empty, null languages are `und`; texts without words give nothing; repeated rows count each;
an empty table gives an empty result; other columns are ignored. A piece is never cut, so a piece of hundreds of
megabytes has to fit in a task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import bit_tables, hashes
from .shipping import ship

LEAST, LONGEST, TOP = 100, 5, 2000
SEPARATORS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
#: Distinct pairs or suffixes a task holds before it hands them on.
HELD = 4_000_000

_KIND = hashes.kinds(BLANKS, SEPARATORS)


def _cut(text: str, limit: int) -> int | None:
    at = max(text.rfind(c, 0, limit) for c in SEPARATORS)
    if at < 0:
        after = [p for c in SEPARATORS if (p := text.find(c, limit)) >= 0]
        at = min(after, default=-1)
    return at + 1 if 0 <= at < len(text) - 1 else None


def _scan(rows: list[tuple], seed: int) -> tuple[hashes.Words, np.ndarray, list[str]]:
    """Words of (lang, text) rows, their names (never 0), and the language of each text."""
    words = hashes.Words([text for _, text in rows], _KIND)
    langs = ["und" if lang is None else lang for lang, _ in rows]
    of = {lang: np.uint64(int.from_bytes(zlib.crc32(f"{seed}:{lang}".encode()).to_bytes(4, "big") * 2, "big")) for lang in set(langs)}
    salts = np.array([of[lang] for lang in langs], np.uint64)
    names = hashes.spread(words.hashes ^ hashes.spread(salts)[words.text])
    names[names == 0] = 1
    return words, names, langs


def _pairs(words: hashes.Words, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word and the next are in one piece, and the hash of both."""
    together = words.piece[1:] == words.piece[:-1]
    return together, hashes.joined([names[:-1], names[1:]])


def _pair_name(low: np.ndarray, part: np.ndarray) -> np.ndarray:
    return hashes.spread((part << np.uint64(32)) | low) >> np.uint64(64 - bit_tables.NAME_BITS)


_FIRST = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("lang", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])
_MERGED = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _pair_blocks(held: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    keys = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
    first, counts = hashes.runs(keys)
    keys = keys[first]
    part = hashes.part_of(keys, parts)
    for a, n in zip(*hashes.runs(part)):
        some = slice(a, a + n)
        low = (keys[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield _batch([(int(part[a]), "pair", None, low.tobytes(), counts[some].astype(np.uint32).tobytes(), None)], _FIRST)


class _Dictionary:
    """Words of a task with their counts: name -> (count, language, spelling)."""

    def __init__(self):
        self.names, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.spelled: dict[int, tuple[str, bytes]] = {}

    def add(self, words: hashes.Words, names: np.ndarray, langs: list[str]) -> None:
        new, first, counts = np.unique(names, return_index=True, return_counts=True)
        for name, k in zip(new.tolist(), first.tolist()):
            if name not in self.spelled:
                self.spelled[name] = langs[words.text[k]], words.spelled(k)
        merged, back = np.unique(np.concatenate((self.names, new)), return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, back, np.concatenate((self.counts, counts)))
        self.names, self.counts = merged, total

    def blocks(self, parts: int) -> Iterator[pa.RecordBatch]:
        part = hashes.part_of(self.names, parts)
        for a, n in zip(*hashes.runs(part)):
            of_lang = defaultdict(list)
            for k in range(a, a + n):
                of_lang[self.spelled[int(self.names[k])][0]].append(k)
            rows = []
            for lang, ks in of_lang.items():
                spelled = b"\n".join(self.spelled[int(x)][1] for x in self.names[ks])
                rows.append((int(part[a]), "word", lang, self.names[ks].tobytes(), self.counts[ks].tobytes(), spelled))
            yield _batch(rows, _FIRST)


def _counted(parts: int, seed: int):
    """Task of the first pass over (lang, text): blocks of pairs, words and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_pairs, totals, words = [], 0, Counter(), _Dictionary()
        for rows in hashes.slices(batches, _cut):
            found, names, langs = _scan(rows, seed)
            for k, n in enumerate(np.bincount(found.text, minlength=len(langs)).tolist()):
                totals[langs[k]] += n
            words.add(found, names, langs)
            together, keys = _pairs(found, names)
            pairs.append(keys[together])
            n_pairs += len(pairs[-1])
            if n_pairs > HELD:
                yield from _pair_blocks(pairs, parts)
                pairs, n_pairs = [], 0
            if len(words.names) > HELD // 4:
                yield from words.blocks(parts)
                words = _Dictionary()
        yield from _pair_blocks(pairs, parts)
        yield from words.blocks(parts)
        yield _batch([(zlib.crc32(lang.encode()) % parts, "total", lang, None, np.int64(n).tobytes(), None) for lang, n in totals.items()], _FIRST)

    return run


def _merged(least: int):
    """Blocks of one part: frequent words, names of frequent pairs, totals of languages, and names of clashing words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, out, part = table.to_pylist(), [], np.uint64(key[0].as_py())
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        if pairs := of("pair"):
            low = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in pairs])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in pairs]).astype(np.int64)
            order = np.argsort(low)
            first, _ = hashes.runs(low[order])
            many = low[order][first][np.add.reduceat(counts[order], first) >= least].astype(np.uint64) if len(first) else low.astype(np.uint64)
            out += [("pair", int(x), None, None, None) for x in np.unique(_pair_name(many, part))]
        if words := of("word"):
            names = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in words])
            counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in words])
            spelled = [(r["lang"], w) for r in words for w in r["words"].split(b"\n")]
            order = np.argsort(names, kind="stable")
            first, lengths = hashes.runs(names[order])
            sums = np.add.reduceat(counts[order], first)
            for k in np.flatnonzero(sums >= least):
                same = {spelled[i] for i in order[first[k] : first[k] + lengths[k]]}
                lang, word = min(same)
                name = int(names[order[first[k]]].view(np.int64))
                out.append(("word" if len(same) == 1 else "clash", name, lang, word.decode(), int(sums[k])))
        totals = Counter()
        for r in of("total"):
            totals[r["lang"]] += int(np.frombuffer(r["counts"], np.int64)[0])
        out += [("total", None, lang, None, n) for lang, n in totals.items()]
        return pa.Table.from_batches([_batch(out, _MERGED)])

    return run


_SUFFIXES = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _equal_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the counts of equal ones put together (a hash brings them side by side)."""
    if not len(rows):
        return rows, counts
    order = np.argsort(hashes.joined(list(rows.T)))
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    return rows[first], np.add.reduceat(counts, first)


def _suffix_blocks(held: list[tuple[np.ndarray, np.ndarray]], lead: int, parts: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    rows, counts = _equal_rows(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))
    part = hashes.part_of(hashes.joined(list(rows[:, :lead].T)), parts)
    order = np.argsort(part, kind="stable")
    for a, n in zip(*hashes.runs(part[order])):
        some = order[a : a + n]
        yield _batch([(int(part[some[0]]), rows.shape[1], rows[some].tobytes(), counts[some].tobytes())], _SUFFIXES)


def _routed(parts: int, seed: int, longest: int, marked, bits: int):
    """Task of the second pass: pairs, and suffixes of three words and more, as far as their pairs are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marked.value, np.uint8)
        held: dict[int, list] = {2: [], longest: []}
        size = {2: 0, longest: 0}
        for rows in hashes.slices(batches, _cut):
            words, names, _ = _scan(rows, seed)
            if len(words) < 2:
                continue
            together, keys = _pairs(words, names)
            ok = together & bit_tables.may_be_in(table, bits, _pair_name(keys & np.uint64(0xFFFFFFFF), hashes.part_of(keys, parts)))
            reach = np.zeros(len(ok) + 1, np.int64)
            for _ in range(longest - 1):
                reach[:-1] = np.where(ok, 1 + reach[1:], 0)
            padded = np.concatenate((names, np.zeros(longest, np.uint64)))
            for width, at in ((2, np.flatnonzero(ok)), (longest, np.flatnonzero(reach >= 2))):
                some = np.stack([np.where(reach[at] >= j, padded[at + j], np.uint64(0)) for j in range(width)], axis=1)
                held[width].append(_equal_rows(some, np.ones(len(some), np.int64)))
                size[width] += len(held[width][-1][0])
                if size[width] > HELD // width:
                    yield from _suffix_blocks(held[width], min(width, 3), parts)
                    held[width], size[width] = [], 0
        for width, blocks in held.items():
            yield from _suffix_blocks(blocks, min(width, 3), parts)

    return run


def frequent(rows: np.ndarray, counts: np.ndarray, least: int, shortest: int) -> Iterator[tuple[np.ndarray, int]]:
    """(words, count) of all leading words, `shortest` or more, that weigh `least`; rows: words by column, 0 after the end.

    Three-way multikey quicksort of pointers to rows. The partition with the pivot's word goes on at the next word.
    """
    stack = [(np.arange(len(rows)), 0)]
    while stack:
        some, depth = stack.pop()
        if counts[some].sum() < least:
            continue
        words = rows[some, depth]
        pivot = words[len(words) // 2]
        for side in (words < pivot, words > pivot):
            if side.any():
                stack.append((some[side], depth))
        same = some[words == pivot]
        weight = int(counts[same].sum())
        if pivot and weight >= least:
            if depth + 1 >= shortest:
                yield rows[same[0], : depth + 1], weight
            if depth + 1 < rows.shape[1]:
                stack.append((same, depth + 1))


_PHRASES = pa.schema([("words", pa.list_(pa.int64())), ("a", pa.int64())])


def _sorted_out(least: int):
    """Suffixes of one part: its frequent phrases. Pairs and longer ones are routed by different words."""

    def run(table: pa.Table) -> pa.Table:
        out, blocks = [], defaultdict(list)
        for r in table.to_pylist():
            blocks[r["width"]].append((np.frombuffer(r["keys"], np.uint64).reshape(-1, r["width"]), np.frombuffer(r["counts"], np.int64)))
        for width, some in blocks.items():
            rows, counts = np.concatenate([x for x, _ in some]), np.concatenate([c for _, c in some])
            for words, n in frequent(rows, counts, least, min(width, 3)):
                out.append((words.view(np.int64).tolist(), n))
        return pa.Table.from_batches([_batch(out, _PHRASES)])

    return run


def _first_pass(docs: DataFrame, least: int, parts: int) -> tuple[DataFrame, int]:
    """(kind, id, lang, word, n) of frequent words, pairs and totals, and the seed that tells the words apart."""
    for seed in range(16):
        blocks = docs.mapInArrow(_counted(parts, seed), "part int, kind string, lang string, keys binary, counts binary, words binary")
        merged = blocks.groupBy("part").applyInArrow(_merged(least), "kind string, id bigint, lang string, word string, n bigint")
        merged = cut_lineage(merged)
        if merged.where("kind = 'clash'").isEmpty():
            return merged, seed
    raise ValueError("no seed tells the frequent words apart")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(words, a): names and counts of all phrases of 2 to `longest` words that occur `least` times; and the table
    (kind, id, lang, word, n) of frequent words (kind word) and of all words of a language (kind total)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged, seed = _first_pass(docs, least, parts)
    table, bits = bit_tables.bit_table(merged.where("kind = 'pair'").select("id"))
    marked = spark.sparkContext.broadcast(table)
    blocks = docs.mapInArrow(_routed(parts, seed, longest, marked, bits), "part int, width int, keys binary, counts binary")
    found = blocks.groupBy("part").applyInArrow(_sorted_out(least), "words array<bigint>, a bigint")
    return cut_lineage(found), merged


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    A phrase scores floor(1000 a n / (l r)) at its lowest-scoring cut into first and other words, which occur l and r times
    among n words; phrases inside a longer one that occurs as often are left out."""
    found, merged = phrases(docs, least, longest)
    known = merged.where("kind = 'word'")
    counts = found.unionByName(known.select(F.array("id").alias("words"), F.col("n").alias("a")))
    totals = merged.where("kind = 'total'").select("lang", "n")

    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))
    inside = found.where(size > 2).select("a", F.explode(inner).alias("words")).groupBy("words").agg(F.max("a").alias("longer"))
    kept = found.join(inside, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).drop("longer")

    spelled = kept.select("words", "a", F.posexplode("words").alias("k", "id")).join(known.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("words", "a").agg(F.any_value("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("k", "word"))).alias("spelled"))
    spelled = spelled.select("words", "a", "lang", F.array_join(F.transform("spelled", lambda x: x["word"]), " ").alias("phrase")).join(totals, "lang")

    cuts = spelled.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    part = lambda name, value: counts.select(F.col("words").alias(name), F.col("a").alias(value))
    cuts = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000 * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
