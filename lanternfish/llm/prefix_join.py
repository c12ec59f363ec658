"""Exact similarity join of shingle sets by grouped prefixes.

Texts are lower-cased (A-Z), words are runs without white space, the set of a text holds its distinct four-word shingles
(with fewer words the whole sequence is the only one). Two sets link when 100 |x & y| >= 85 |x | y|.

Shingles are ordered by how often they occur (classes of a counting table of fixed size), then by hash. Sets that link
share one of their first n - ceil(0.85 n) + 1 shingles, the prefix. Equal sets are one class, classes with the same prefix
and size one group. Lists of the groups that share a prefix shingle are made once for each group, however many documents
it has. What the lists hold is linked in rounds:
* two rounds in which a class is compared in one list only, the largest that isn't of one component yet; members verify
  each other on their full sets, large lists are dealt out by hash, differently in each round;
* then all lists with several components, whole: pairs of groups pass the size and position filters, their members are
  expanded and pass a bit filter, pairs across components are verified on the full sets. In large lists blocks of the
  classes outside the main component meet all parts of the list. Every filter is a bound, no link is lost.

Defined cases: null and blank texts have an empty set and are linked with nothing; documents with equal sets are linked;
rows with the same doc_id are judged by their own texts; a null doc_id doesn't count as the smallest of a component; an
empty table gives an empty result; other columns are ignored. Classes are named by 64 of the 128 bits of their fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import bit_tables, hashes, shingles
from .common import BLANKS, LAST_ID
from .near_dedup import components
from .shipping import ship

WIDTH = 4
#: Percent of the union that two linked sets have in common.
SIMILAR = 85
#: Places of the counting table that orders shingles, as a power of two; 8 MB when it is handed out.
PLACES = 23
_CHUNK = 1 << 16
#: Bits of the filter on full sets, and of a second one for sets of more than `LARGE` shingles.
BITS, MORE_BITS, LARGE = 1024, 16384, 1500
#: Up to so many names (8 bytes each) are handed to all tasks to tell which sets a round needs.
FEW_NAMES = 2_000_000
#: Classes of a list that are compared with each other in one task.
PIECE = 1000
#: Neighbours in a list, by size, that are looked at before lists are made.
NEAR = 8
#: Postings a task holds before it hands them on.
HELD = 4_000_000

_KIND = hashes.kinds(BLANKS)
_WEIGHT = np.uint64(0xA24BAED4963EE407)


def _no_cut(text: str, limit: int) -> None:
    return None


def _shingled(texts: list[str]) -> list[np.ndarray]:
    """Shingles of every text, repeated ones included."""
    words = hashes.Words(texts, _KIND)
    rolled = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        rolled = rolled * _WEIGHT + words.hashes[k : k + len(rolled)]
    rolled = hashes.spread(rolled)
    first = np.searchsorted(words.text, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WIDTH:
            out.append(rolled[a : b - WIDTH + 1])
        elif b > a:
            out.append(hashes.joined([words.hashes[k : k + 1] for k in range(a, b)] + [np.array([b - a], np.uint64)]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingles of every text."""
    return [np.unique(s) for s in _shingled(texts)]


def prefix_length(n: int) -> int:
    return n + (-SIMILAR * n // 100) + 1 if n else 0


# ---------------------------------------------------------------- the order of shingles


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: how often shingles fall on each place of the table, in chunks; places without any aren't sent."""
    total = np.zeros(1 << PLACES, np.uint8)
    for rows in hashes.slices(batches, _no_cut):
        flat = np.concatenate(_shingled([r[0] for r in rows]))
        place, n = np.unique(flat >> np.uint64(64 - PLACES), return_counts=True)
        # a task counts to 255, enough to tell rare shingles from others
        total[place] = np.minimum(total[place] + n, 255)
    for chunk in range(len(total) // _CHUNK):
        some = total[chunk * _CHUNK :][:_CHUNK]
        at = np.flatnonzero(some).astype(np.uint16)
        if len(at):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "places": [at.tobytes()], "counts": [some[at].tobytes()]})


def _classed(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, np.float64)
    for at, n in zip(table["places"].to_pylist(), table["counts"].to_pylist()):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "classes": [np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8).tobytes()]})


def frequency_classes(docs: DataFrame) -> tuple[bytes, int]:
    """Class of every place of the table: eight times the logarithm of the occurrences of the shingles that fall on it; and
    the class from which on shingles are hot: 2^14 occurrences, and 16 times as many as the median place."""
    tallies = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_tallied, "chunk int, places binary, counts binary")
    chunks = tallies.groupBy("chunk").applyInArrow(_classed, "chunk int, classes binary")
    out = np.zeros(1 << PLACES, np.uint8)
    for row in chunks.collect():  # of fixed size
        out[row["chunk"] * _CHUNK :][:_CHUNK] = np.frombuffer(row["classes"], np.uint8)
    return out.tobytes(), max(8 * 14, int(np.median(out)) + 8 * 4)


# ---------------------------------------------------------------- facts, groups and lists

_FACTS = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("gid", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("more_bits", pa.binary())]
)


def _bits(s: np.ndarray, bits: int = BITS) -> bytes:
    """Parity of the shingles on each bit: two sets differ in at least as many shingles as these in bits."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _facts(classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_place = np.frombuffer(classes.value, np.uint8)
        for rows in hashes.slices(batches, _no_cut):
            out = []
            for (doc_id, text_hash, _), s in zip(rows, shingle_sets([r[2] for r in rows])):
                rank = np.lexsort((s, of_place[s >> np.uint64(64 - PLACES)]))
                prefix = s[rank[: prefix_length(len(s))]]
                gid = np.add.reduce(hashes.spread(prefix ^ hashes.spread(np.array([len(s)], np.uint64)))) if len(s) else np.uint64(0)
                out.append((doc_id, text_hash, len(s), *shingles.fingerprint(s), int(gid.view(np.int64)), prefix.view(np.int64), _bits(s), _bits(s, MORE_BITS) if len(s) > LARGE else None))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FACTS)], schema=_FACTS)

    return run


_BLOCK = ("token", "gid", "pos", "n")


def _post_blocks(held: list[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    token, gid, pos, n, place = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(place)
    part = hashes.part_of(place[order], parts)
    for a, size in zip(*hashes.runs(part)):
        some = order[a : a + size]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(part[a])], pa.int32()), *[pa.array([c[some].tobytes()], pa.binary()) for c in (token, gid, pos, n)]], ["part", *_BLOCK]
        )


def _posted(parts: int, classes, hot: int):
    """Task over (gid, n, prefix): blocks of postings; a group counts once in a task. Hot shingles are salted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_place = np.frombuffer(classes.value, np.uint8)
        seen, held, size = np.empty(0, np.int64), [], 0
        for batch in batches:
            gid, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = ~np.isin(gid, seen)
            gid, first = gid[new], first[new]
            seen = np.concatenate((seen, gid))
            if not len(gid):
                continue
            prefix = batch.column(2).take(pa.array(first))
            lengths = np.diff(prefix.offsets.to_numpy())
            token = prefix.flatten().to_numpy().view(np.uint64)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            n, group = np.repeat(batch.column(1).to_numpy()[first], lengths), np.repeat(gid, lengths)
            # one of as many parts as the shingle has thousands of occurrences
            rank = of_place[token >> np.uint64(64 - PLACES)]
            salts = np.left_shift(np.uint64(1), np.maximum(rank.astype(np.int64) // 8 - 10, 0).astype(np.uint64))
            salt = np.where(rank >= hot, hashes.spread(group.view(np.uint64)) % salts, np.uint64(0))
            held.append((token, group, pos.astype(np.uint32), n.astype(np.uint32), hashes.spread(token + salt)))
            size += len(token)
            if size > HELD:
                yield from _post_blocks(held, parts)
                held, size = [], 0
        if held:
            yield from _post_blocks(held, parts)

    return run


def _shared(classes, hot: int):
    """Postings of one part that another group shares. In lists of up to `NEAR` + 1 groups one that passes the size and
    position filters, in longer ones the next one by size; lists of hot shingles, which lie in several parts, stay whole."""

    def run(table: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.int64, np.uint32, np.uint32)
        token, gid, pos, n = (np.concatenate([np.frombuffer(b, k) for b in table[c].to_pylist()]) for c, k in zip(_BLOCK, kinds))
        order = np.lexsort((gid, n, token))
        token, gid, pos, n = token[order], gid[order], pos[order].astype(np.int64), n[order].astype(np.int64)
        once = np.concatenate(([True], (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])))
        token, gid, pos, n = token[once], gid[once], pos[once], n[once]
        of_place = np.frombuffer(classes.value, np.uint8)
        is_hot = of_place[token >> np.uint64(64 - PLACES)] >= hot
        keep, left = is_hot.copy(), n - pos
        _, size = hashes.runs(token)
        long = np.repeat(size > NEAR + 1, size)
        for k in range(1, min(NEAR, len(token) - 1) + 1):
            near = (token[k:] == token[:-k]) & (100 * n[:-k] >= SIMILAR * n[k:])
            # what two sets can have in common from their first common shingle on
            near &= ((k == 1) & long[k:]) | ((100 + SIMILAR) * np.minimum(left[:-k], left[k:]) >= SIMILAR * (n[:-k] + n[k:]))
            keep[k:] |= near
            keep[:-k] |= near
        return pa.table({"token": token[keep].view(np.int64), "gid": gid[keep], "pos": pos[keep], "hot": is_hot[keep]})

    return run


def lists(rows: DataFrame, classes: DataFrame, order, hot: int) -> DataFrame:
    """(token, pos, hot, gid, node, n, bits): members of all lists; rows: facts, classes: (node, gid, n, bits). Groups of
    several classes are lists of their own, named by the group."""
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = rows.where("n > 0").select("gid", "n", "prefix")
    blocks = posted.mapInArrow(_posted(parts, order, hot), "part int, token binary, gid binary, pos binary, n binary")
    shared = blocks.groupBy("part").applyInArrow(_shared(order, hot), "token bigint, gid bigint, pos bigint, hot boolean")
    several = classes.groupBy("gid").agg(F.count("*").alias("size")).where("size > 1")
    own = several.select(F.col("gid").alias("token"), "gid", F.lit(0).cast("long").alias("pos"), (F.col("size") > PIECE).alias("hot"))
    return shared.unionByName(own).join(classes, "gid").select("token", "pos", "hot", "gid", "node", "n", "bits")


# ---------------------------------------------------------------- comparisons


def _by_piece(solve: Callable[[pa.Table], list[tuple[int, int]]]):
    """Task over rows that come sorted by `piece`: pairs (a, b) that solve finds in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            pairs = np.array(solve(pa.Table.from_batches(held)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held, last = [], None
        for batch in batches:
            piece = batch.column(0).to_numpy()
            for a, n in zip(*hashes.runs(piece)):
                if held and piece[a] != last:
                    yield told(held)
                    held = []
                held.append(batch.slice(a, n))
                last = piece[a]
        if held:
            yield told(held)

    return run


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in names]


def _words_of_bits(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _may_link(bits: np.ndarray, n: np.ndarray, a: int, some: np.ndarray) -> np.ndarray:
    """Those of some whose sizes and bits allow a link with a."""
    some = some[100 * np.minimum(n[some], n[a]) >= SIMILAR * np.maximum(n[some], n[a])]
    apart = np.bitwise_count(bits[some] ^ bits[a]).sum(axis=1, dtype=np.int64)
    # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
    return some[(100 + SIMILAR) * apart <= (100 - SIMILAR) * (n[some] + n[a])]


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= SIMILAR * (len(x) + len(y) - common)


def _links_within(rows: pa.Table) -> list[tuple[int, int]]:
    """Links that join the components of one piece; of links between two components one is enough."""
    if rows.num_rows < 2:
        return []
    node, n, root = _columns(rows, "node", "n", "root")
    root, bits, sets, links = root.copy(), _words_of_bits(rows), rows["shingles"].combine_chunks(), []
    flat, ends = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
    of = lambda k: flat[ends[k] : ends[k + 1]]
    for a in range(1, len(node)):
        some = np.flatnonzero(root[:a] != root[a])
        some = _may_link(bits, n, a, some) if len(some) else some
        while len(some):
            b, some = some[0], some[1:]
            if _linked(of(a), of(b)):
                links.append((node[a], node[b]))
                root[root == root[b]] = root[a]
                some = some[root[some] != root[a]]
    return links


def _open_pairs(rows: pa.Table) -> list[tuple[int, int]]:
    """Pairs across components that no filter rules out, of a block of a list with another part of it."""
    node, gid, n, pos, root, outer, block = _columns(rows, "node", "gid", "n", "pos", "root", "outer", "block")
    bits = _words_of_bits(rows)
    firsts, others = np.flatnonzero(block), np.flatnonzero(~block)
    found = []
    # groups first: their size and the place of the shingle bound what two of them can have in common
    groups, first, of_group = np.unique(gid[others], return_index=True, return_inverse=True)
    size, place = n[others][first], pos[others][first]
    for g in np.unique(gid[firsts]):
        members = firsts[gid[firsts] == g]
        own, at = n[members[0]], pos[members[0]]
        most = 1 + np.minimum(size - place - 1, own - at - 1)
        fit = (100 * np.minimum(size, own) >= SIMILAR * np.maximum(size, own)) & ((100 + SIMILAR) * most >= SIMILAR * (size + own))
        # members of one group have the whole prefix in common, so the place says nothing of the rest
        fit |= groups == g
        expanded = others[fit[of_group]]
        for a in members:
            some = expanded[root[expanded] != root[a]]
            some = some[~(outer[some] & (node[some] <= node[a]))]  # else a pair of two outer classes comes twice
            found += [(min(node[a], node[b]), max(node[a], node[b])) for b in _may_link(bits, n, a, some)]
    return found


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over members that come sorted by token: those whose size and bits allow a link with another one of the list.
    Lists of more than `PIECE` members pass whole. Large sets come with the other one, null in lists of over `NEAR` + 1."""

    def told(rows: pa.Table) -> pa.Table:
        token, n, node = _columns(rows, "token", "n", "node")
        bits, keep, pairs = _words_of_bits(rows), np.zeros(len(token), bool), []
        first, size = hashes.runs(token)
        for k in range(1, min(NEAR, len(token) - 1) + 1):
            i = np.flatnonzero((token[k:] == token[:-k]) & np.repeat(size <= NEAR + 1, size)[k:])
            i = i[100 * np.minimum(n[i], n[i + k]) >= SIMILAR * np.maximum(n[i], n[i + k])]
            apart = np.bitwise_count(bits[i] ^ bits[i + k]).sum(axis=1, dtype=np.int64)
            i = i[(100 + SIMILAR) * apart <= (100 - SIMILAR) * (n[i] + n[i + k])]
            both = (n[i] > LARGE) & (n[i + k] > LARGE)
            pairs += [(i[both], node[i + k][both]), (i[both] + k, node[i][both])]
            keep[i[~both]] = keep[i[~both] + k] = True
        for a, m in zip(first[size > NEAR + 1], size[size > NEAR + 1]):
            if m > PIECE:
                keep[a : a + m] = True
                continue
            for b in range(a + 1, a + m):
                some = _may_link(bits, n, b, np.arange(a, b))
                keep[some] = True
                keep[b] |= len(some) > 0
        kept = rows.select(["token", "pos", "gid", "node"])
        at = np.concatenate([np.flatnonzero(keep), *[i for i, _ in pairs]])
        other = np.concatenate([np.zeros(int(keep.sum()), np.int64), *[x for _, x in pairs]])
        known = np.concatenate([np.zeros(int(keep.sum()), bool), *[np.ones(len(i), bool) for i, _ in pairs]])
        return kept.take(pa.array(at)).append_column("other", pa.array(other, mask=~known))

    def whole(rows: pa.Table) -> pa.Table:
        return rows.select(["token", "pos", "gid", "node"]).append_column("other", pa.nulls(rows.num_rows, pa.int64()))

    held, passing = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if passing is not None:  # the rest of a list that has passed
            same = rows["token"].to_numpy() == passing
            yield from whole(rows.filter(pa.array(same))).combine_chunks().to_batches()
            rows = rows.filter(pa.array(~same))
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        first, _ = hashes.runs(rows["token"].to_numpy())
        last = int(first[-1])
        done, held = rows.slice(0, last), rows.slice(last)
        if held.num_rows > PIECE:
            done, passing, held = rows, held["token"][0].as_py(), None
        yield from told(done).combine_chunks().to_batches()
    if held is not None:
        yield from told(held).combine_chunks().to_batches()


def _far_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over pairs of large sets: those that the second bits don't rule out."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(-1, MORE_BITS // 64) for c in ("x", "y"))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        yield batch.select(["node"]).filter(pa.array((100 + SIMILAR) * apart <= (100 - SIMILAR) * batch["n"].to_numpy()))


def partnered(members: DataFrame, large: DataFrame) -> DataFrame:
    """(token, pos, gid, node): members of lists without those whose bits rule out all others of their list.

    large: (node, n, more_bits). What keeps large sets in small lists is checked once for each pair of them, whatever the
    number of shingles they share."""
    columns = ["token", "pos", "gid", "node"]
    ordered = members.where("not hot").select(*columns, "n", "bits").repartition("token").sortWithinPartitions("token")
    found = cut_lineage(ordered.mapInArrow(_partnered, "token bigint, pos bigint, gid bigint, node bigint, other bigint"))
    pairs = found.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    of = lambda side, bits: large.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("more_bits").alias(bits))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    ends = both.select(F.array("a", "b").alias("node"), (F.col("na") + F.col("nb")).alias("n"), "x", "y").mapInArrow(_far_apart, "node array<bigint>")
    near = cut_lineage(ends.select(F.explode("node").alias("node")).distinct())
    kept = found.where("other is null").select(*columns).unionByName(found.where("other is not null").join(near, "node", "left_semi").select(*columns).distinct())
    return members.where("hot").select(*columns).unionByName(kept)


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _needed(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets of some nodes, each once; where nodes are few, others aren't shuffled to find out."""
    if nodes.count() <= FEW_NAMES:
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    return sets.dropDuplicates(["node"])


def in_one_list(members: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame | None, salt: int) -> DataFrame:
    """(a, b): links found when every class is compared in its largest list of several components."""
    rooted = cut_lineage(_rooted(members, roots).select("token", "node", "root"))
    crowds = rooted.groupBy("token").agg(F.count("*").alias("crowd"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    chosen = rooted.join(crowds.select("token", "crowd"), "token").groupBy("node", "root").agg(F.max(F.struct("crowd", "token")).alias("at"))
    dealt = F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("at.crowd") / PIECE))
    placed = cut_lineage(chosen.select(F.xxhash64("at.token", dealt).alias("piece"), "node", "root"))
    placed = placed.join(classes, "node").join(_needed(sets, placed.select("node")), "node")
    ordered = placed.select("piece", "node", "n", "root", "bits", "shingles").repartition("piece").sortWithinPartitions("piece", "node")
    return ordered.mapInArrow(_by_piece(_links_within), "a bigint, b bigint")


def across_components(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all pairs across components in all lists that no filter rules out; classes: (node, n, bits)."""
    rooted = cut_lineage(_rooted(members, roots))
    shares = rooted.groupBy("token", "root").agg(F.count("*").alias("size"))
    crowds = shares.groupBy("token").agg(F.sum("size").alias("crowd"), F.max(F.struct("size", "root")).alias("main"))
    still = crowds.where("crowd > main.size").select(
        "token", F.col("main.root").alias("main"), F.ceil((F.col("crowd") - F.col("main.size")) / PIECE).alias("blocks"), F.ceil(F.col("crowd") / PIECE).alias("parts")
    )
    unmet = rooted.join(cut_lineage(still), "token").withColumn("outer", F.col("root") != F.col("main"))
    dealt = lambda k, n: F.pmod(F.xxhash64("node", "token", F.lit(k)), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    part = F.transform(upto("blocks"), lambda i: F.struct(F.lit(False).alias("block"), i.alias("i"), dealt(1, "parts").alias("j")))
    block = F.transform(upto("parts"), lambda j: F.struct(F.lit(True).alias("block"), dealt(0, "blocks").alias("i"), j.alias("j")))
    places = F.explode(F.when(F.col("outer"), F.concat(part, block)).otherwise(part))
    spread_out = unmet.select("token", "node", "gid", "pos", "root", "outer", places.alias("p")).select(
        F.xxhash64("token", "p.i", "p.j").alias("piece"), "node", "gid", "pos", "root", "outer", "p.block"
    )
    ordered = spread_out.join(classes, "node").repartition("piece").sortWithinPartitions("piece")
    ordered = ordered.select("piece", "node", "gid", "n", "pos", "root", "outer", "block", "bits")
    return ordered.mapInArrow(_by_piece(_open_pairs), "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    ends = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _needed(sets, ends)
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= SIMILAR * (F.size("sa") + F.size("sb") - common)).select("a", "b")


_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _sets(table, bits: int):
    """Task over (name, text): full sets of the texts whose name is in a bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(table.value, np.uint8)

        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bit_tables.may_be_in(wanted, bits, batch.column(0).to_numpy().view(np.uint64))))

        for rows in hashes.slices(passing(), _no_cut):
            sets = [s for s in shingle_sets([r[1] for r in rows]) if len(s)]
            nodes = [shingles.fingerprint(s)[0] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=_SETS)

    return run


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id): one row per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    classed, hot = frequency_classes(texts)
    order = spark.sparkContext.broadcast(classed)
    kinds = "doc_id bigint, text_hash bigint, n bigint, f1 bigint, f2 bigint, gid bigint, prefix array<bigint>, bits binary, more_bits binary"
    rows = cut_lineage(texts.mapInArrow(_facts(order), kinds))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(LAST_ID)), "text_hash")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), key.alias("key"))).alias("one")
    classes = rows.where("n > 0").groupBy("f1", "f2", "n", "gid").agg(least, F.min("doc_id").alias("id"), F.any_value("bits").alias("bits"), F.any_value("more_bits").alias("more_bits"))
    classes = cut_lineage(classes.select(F.col("f1").alias("node"), "n", "gid", "one.key", "id", "bits", "more_bits"))

    large = classes.where(F.col("n") > LARGE).select("node", "n", "more_bits")
    members = cut_lineage(partnered(lists(rows, classes.select("node", "gid", "n", "bits"), order, hot), large))
    wanted = cut_lineage(members.select("node").distinct().join(classes, "node").select("node", "n", "bits", bit_tables.name_of(F.col("key")).alias("id")))
    # texts stay where they are: a bounded table tells which of them are read once more
    table, bits = bit_tables.bit_table(wanted.select("id"))
    read = texts.select(bit_tables.name_of(key).alias("name"), "text")
    sets = cut_lineage(read.mapInArrow(_sets(spark.sparkContext.broadcast(table), bits), "node bigint, shingles array<bigint>"))

    some = wanted.select("node", "n", "bits")
    links = cut_lineage(in_one_list(members, some, sets, None, 0))
    roots = components(links)
    links = cut_lineage(links.unionByName(in_one_list(members, some, sets, roots, 1)))
    roots = components(links)
    more = cut_lineage(across_components(members, some, roots))
    links = cut_lineage(links.unionByName(_confirmed(more, sets)))
    roots = components(links)

    rooted = cut_lineage(classes.select("node", "id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = rooted.join(smallest, "root").select(F.col("node").alias("f1"), "component_id")
    placed = rows.select("doc_id", "text_hash", "n", "f1").join(of_class, "f1", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))
