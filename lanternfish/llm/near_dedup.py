"""Near-duplicates with an LSH forest over MinHash signatures.

Documents with equal shingle sets form one class. The signature of a class is read in `TREES` orders, each a rotation of
the same values; classes that share the first `LEAST_DEPTH` values of an order lie in one region. A region is divided by
longer prefixes, and every class is held against
* the leader of its region at each depth, the class that shares regions with most others, and
* its neighbours in the order, those with the longest common prefix. Large regions are ordered piecewise, by the
  shallowest longer prefix that few enough classes share, so the depth adapts to the class and no task gets a large one.

Candidates whose sizes, signatures or sketches rule out the similarity are dropped (the bounds are five standard
deviations below the threshold). The most similar leader of every class is confirmed on the full sets first, then the
other leaders and the next neighbour of every order, then all neighbours; each time only candidates that would join two
components are looked at, so members of a group that have met aren't held against each other again. Last, in regions
that are larger than the reach of the neighbours and have several components still, every pair across components is
examined, on the full sets and in place, so that no candidate becomes a row. A pair at the threshold meets in some region
with probability 1 - (1 - 0.75^3)^24 > 0.999997, more similar pairs more surely.

Defined cases: null and blank texts have an empty set and are linked with nothing; documents with equal sets are linked;
rows with the same doc_id are judged by their own texts; a null doc_id doesn't count as the smallest of a component and
its row is kept only if the component has no id at all; an empty table gives an empty result. Classes are named by 64 of
the 128 bits of their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import shingles
from .common import LAST_ID, packed
from .shipping import ship

SIMILAR = 0.75
#: Candidates whose signatures agree in less than this share of values are dropped.
POSSIBLE = 0.5
#: Prefix lengths at which regions have leaders and by which they are ordered.
DEPTHS = (3, 4, 6, 9, 14)
#: Classes in one piece of an order, about.
PIECE = 500
#: Neighbours that follow a class in an order and are held against it: first the next one, which joins most of a large
#: group, then all that are still in different components.
NEIGHBOURS = (1, 24)

_FACTS = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.list_(pa.int32())), ("short", pa.binary())]
)
_SETS = pa.schema([("f1", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _slices(batches: Iterator[pa.RecordBatch], n: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            yield batch.slice(start, n)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        sets = shingles.shingle_sets(part.column(2).to_pylist())
        prints = [shingles.fingerprint(s) for s in sets]
        sigs = np.concatenate([shingles.signature(s) for s in sets]).view(np.int32)
        ends = np.arange(len(sets) + 1, dtype=np.int32) * shingles.HASHES
        columns = [
            part.column(0),
            part.column(1),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([p[0] for p in prints], pa.int64()),
            pa.array([p[1] for p in prints], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(sigs)),
            pa.array([v.tobytes() + shingles.sketch(s) for v, s in zip(sigs.reshape(len(sets), -1).astype(np.uint8), sets)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=_FACTS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        sets = [s.view(np.int64) for s in shingles.shingle_sets(part.column(1).to_pylist())]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = pa.array(np.concatenate(sets))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=_SETS)


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, sig, short): set size, fingerprint, signature of every row,
    and the low bytes of the signature with a sketch."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_facts, "doc_id bigint, text_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<int>, short binary")


def _prefix(tree: Column, depth: int) -> Column:
    """Name of a region: a hash of the tree and the first values of its order."""
    places = [F.pmod(tree * shingles.LEAST_DEPTH + k, F.lit(shingles.HASHES)) for k in range(depth)]
    return F.xxhash64(tree, F.lit(depth), *[F.get("sig", p.cast("int")) for p in places])


def forest(classes: DataFrame) -> DataFrame:
    """(node, n, score, crowd, d3, d4, ..., piece): for every order in which a class shares its region, the size of that
    region, the names of the regions of longer prefixes and the piece in which it is ordered; classes: (node, n, sig)."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(shingles.TREES - 1)))
    planted = classes.withColumn("tree", tree).select("node", "tree", _prefix(F.col("tree"), DEPTHS[0]).alias("region"))
    # most classes are alone everywhere; only regions of two or more go on
    crowded = planted.groupBy("region").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = cut_lineage(planted.join(crowded, "region"))
    involved = members.groupBy("node").agg(F.sum("crowd").alias("score"), F.collect_set(F.struct("tree", "crowd")).alias("trees"))
    grown = (
        involved.join(classes, "node")
        .select("node", "n", "score", "sig", F.explode("trees").alias("t"))
        .select("node", "n", "score", "t.crowd", *[_prefix(F.col("t.tree"), d).alias(f"d{d}") for d in DEPTHS])
    )
    return _with_piece(cut_lineage(grown))


def _with_piece(rows: DataFrame) -> DataFrame:
    """Add `piece`: the region itself up to PIECE classes. In a larger one a class lies with all that share its shallowest
    longer prefix of at most PIECE classes; classes of deepest prefixes that are larger still are dealt out by hash."""
    deeper = DEPTHS[1:]
    inner = rows.where(F.col("crowd") > PIECE).select(F.explode(F.array(*[f"d{d}" for d in deeper])).alias("region"))
    large = cut_lineage(inner.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > PIECE))
    for d in deeper:
        rows = rows.join(large.select(F.col("region").alias(f"d{d}"), F.col("size").alias(f"size{d}")), f"d{d}", "left")
    whole = [F.when(F.col(f"size{d}").isNull(), F.col(f"d{d}")) for d in deeper]
    last = f"d{deeper[-1]}"
    dealt = F.xxhash64(last, F.pmod(F.xxhash64("node", last), F.ceil(F.col(f"size{deeper[-1]}") / PIECE)))
    piece = F.when(F.col("crowd") <= PIECE, F.col(f"d{DEPTHS[0]}")).otherwise(F.coalesce(*whole, dealt))
    return rows.select("node", "n", "score", "crowd", *[f"d{d}" for d in DEPTHS], piece.alias("piece"))


def _fits(m: Column, n: Column) -> Column:
    return F.least(m, n) >= SIMILAR * F.greatest(m, n)


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def led(rows: DataFrame) -> DataFrame:
    """(a, b): every class with the leaders of its regions, each pair once."""
    regions = rows.select("node", "n", "score", F.explode(F.array(*[f"d{d}" for d in DEPTHS])).alias("region"))
    leaders = regions.groupBy("region").agg(F.max(F.struct("score", "node", "n")).alias("top"), F.count("*").alias("crowd")).where("crowd > 1")
    pairs = regions.join(leaders, "region").where((F.col("node") != F.col("top.node")) & _fits(F.col("n"), F.col("top.n")))
    return pairs.select(*_pairs(F.col("node"), F.col("top.node"))).distinct()


def _met(reach: int):
    """Task of `neighbours`: rows come sorted by piece and order; the last ones of a batch are held for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            numbers = [batch.column(k).to_numpy() for k in range(4)]
            shorts = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, shingles.HASHES + shingles.BINS)
            now = [*numbers, shorts]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now)]
            old = len(now[0]) - batch.num_rows
            piece, node, n, root, short = now
            found = []
            for k in range(1, min(reach, len(node) - 1) + 1):
                i = np.arange(max(old - k, 0), len(node) - k)
                i = i[(piece[i] == piece[i + k]) & (root[i] != root[i + k])]
                i = i[np.minimum(n[i], n[i + k]) >= SIMILAR * np.maximum(n[i], n[i + k])]
                i = i[(short[i, : shingles.HASHES] == short[i + k, : shingles.HASHES]).sum(axis=1) >= POSSIBLE * shingles.HASHES]
                i = i[shingles.may_be_similar(short[i, shingles.HASHES :], short[i + k, shingles.HASHES :], n[i] + n[i + k], SIMILAR)]
                found.append(np.stack((np.minimum(node[i], node[i + k]), np.maximum(node[i], node[i + k])), axis=1))
            held = [x[-reach:] for x in now]
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            ones, starts = np.unique(pairs[:, 0], return_index=True)
            ends = pa.array(np.append(starts, len(pairs)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ones), pa.ListArray.from_arrays(ends, pa.array(pairs[:, 1]))], ["a", "others"])

    return run


def neighbours(rows: DataFrame, classes: DataFrame, roots: DataFrame, reach: int) -> DataFrame:
    """(a, b): classes at most `reach` places apart in an order that are in different components still and whose sizes and
    signatures allow a link; classes: (node, short), roots: (node, root)."""
    known = classes.join(roots, "node", "left").select("node", "short", F.coalesce("root", "node").alias("root"))
    placed = rows.join(known, "node")
    ordered = placed.repartition("piece").sortWithinPartitions("piece", *[f"d{d}" for d in DEPTHS], "node")
    # signatures are compared where neighbours meet; what all orders found is put together before it becomes rows:
    # 24 orders of 2 * reach at most for each class
    found = ordered.select("piece", "node", "n", "root", "short").mapInArrow(_met(reach), "a bigint, others array<bigint>")
    found = found.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    return found.select("a", F.explode("others").alias("b"))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, alike): pairs whose signatures, one byte a value, agree in enough places."""
    short = classes.select("node", F.transform("sig", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte")).alias("s"))
    of = lambda side: short.select(F.col("node").alias(side), F.col("s").alias(f"s{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    alike = (same / shingles.HASHES).alias("alike")
    return both.select("a", "b", alike).where(F.col("alike") >= POSSIBLE)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    of = lambda side: sets.select(F.col("f1").alias(side), F.col("shingles").alias(f"s{side}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= 75 * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): contraction of links (a, b). In every round each node follows its neighbour, or itself, of least
    hash; links between different followed nodes remain. Stars take two rounds, chains a logarithm of their length."""
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = None
    while not edges.isEmpty():
        least = edges.groupBy("a").agg(F.min(first("b")).alias("m"))
        step = cut_lineage(least.select(F.col("a").alias("node"), F.least(F.col("m"), first("a"))["node"].alias("root")))
        if roots is None:
            roots = step
        else:
            after = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut_lineage(roots.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = lambda side: step.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        edges = edges.join(ends("a"), "a").join(ends("b"), "b").where("a_root <> b_root")
        edges = cut_lineage(edges.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _open_pairs(rows: pa.Table) -> pa.Table:
    """Task of `rest`: links of the classes of a block outside the main component with those of another block. Of links
    between two components one is enough."""
    number = lambda name: rows[name].to_numpy()
    node, n, root, region, outer, block = map(number, ("node", "n", "root", "d3", "outer", "block"))
    root = root.copy()
    regions = np.stack(rows["regions"].to_numpy())
    short = np.frombuffer(b"".join(rows["short"].to_pylist()), np.uint8).reshape(-1, shingles.HASHES + shingles.BINS)
    sets = rows["shingles"].to_numpy()
    firsts, others = np.flatnonzero(block), np.flatnonzero(~block)
    ids, starts, links = None, None, []
    for a in firsts:
        # a pair of two outer classes comes twice; a pair that shares an earlier region is examined there
        c = others[(root[others] != root[a]) & ~(outer[others] & (node[others] <= node[a]))]
        c = c[np.minimum(n[c], n[a]) >= SIMILAR * np.maximum(n[c], n[a])]
        shared = regions[c] == regions[a]
        c = c[regions[a][shared.argmax(axis=1)] == region[a]] if len(c) else c
        c = c[(short[c, : shingles.HASHES] == short[a, : shingles.HASHES]).sum(axis=1) >= POSSIBLE * shingles.HASHES]
        c = c[shingles.may_be_similar(short[c, shingles.HASHES :], short[a, shingles.HASHES :], n[c] + n[a], SIMILAR)]
        if len(c) and ids is None:
            starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            marked = np.zeros(len(ids) + 1, bool)
        while len(c):
            some, c = c[:32], c[32:]
            mine = ids[starts[a] : starts[a + 1]]
            marked[mine] = True
            common = np.array([marked[ids[starts[b] : starts[b + 1]]].sum() for b in some])
            marked[mine] = False
            for b in some[100 * common >= 75 * (n[some] + n[a] - common)]:
                if root[b] != root[a]:
                    links.append((min(node[a], node[b]), max(node[a], node[b])))
                    root[root == root[b]] = root[a]
            c = c[root[c] != root[a]]
    found = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def rest(rows: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between components in regions whose classes the neighbours of the last round did not all reach;
    classes: (node, short, regions), the last being the names of the regions in all orders."""
    members = rows.where(F.col("crowd") > NEIGHBOURS[-1] + 1).select("node", "n", "d3")
    members = cut_lineage(members.join(roots, "node", "left").select("node", "n", "d3", F.coalesce("root", "node").alias("root")))
    parts = members.groupBy("d3", "root").agg(F.count("*").alias("size"))
    regions = parts.groupBy("d3").agg(F.sum("size").alias("crowd"), F.max(F.struct("size", "root")).alias("main"))
    still = regions.where("crowd > main.size").select(
        "d3", F.col("main.root").alias("main"), F.ceil((F.col("crowd") - F.col("main.size")) / PIECE).alias("blocks"), F.ceil(F.col("crowd") / PIECE).alias("parts")
    )
    unmet = members.join(cut_lineage(still), "d3").withColumn("outer", F.col("root") != F.col("main"))
    # every block of classes outside the main component meets every part of the region, in a task of its own
    dealt = lambda k, n: F.pmod(F.xxhash64("node", "d3", F.lit(k)), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    part = F.transform(upto("blocks"), lambda i: F.struct(F.lit(False).alias("block"), i.alias("i"), dealt(1, "parts").alias("j")))
    block = F.transform(upto("parts"), lambda j: F.struct(F.lit(True).alias("block"), dealt(0, "blocks").alias("i"), j.alias("j")))
    places = F.explode(F.when(F.col("outer"), F.concat(part, block)).otherwise(part))
    dealt_out = unmet.select("node", "n", "root", "d3", "outer", places.alias("p")).select(
        "node", "n", "root", "d3", "outer", "p.block", F.xxhash64("d3", "p.i", "p.j").alias("piece")
    )
    full = dealt_out.join(classes, "node").join(sets.withColumnRenamed("f1", "node"), "node")
    return full.groupBy("piece").applyInArrow(_open_pairs, "a bigint, b bigint")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept): one row per row of docs."""
    rows = cut_lineage(facts(docs))
    named = rows.where("n_shingles > 0")
    # one class for equal sets; the text of one of its rows stands for all
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text_hash")).alias("one")
    classes = named.groupBy("f1", "f2", "n_shingles").agg(least, F.min("doc_id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("short").alias("short"))
    classes = cut_lineage(classes.select(F.col("f1").alias("node"), F.col("n_shingles").alias("n"), "one", "id", "sig", "short"))
    grown = cut_lineage(forest(classes.select("node", "n", "sig")))

    regions = F.array(*[_prefix(F.lit(t), DEPTHS[0]) for t in range(shingles.TREES)]).alias("regions")
    wanted = cut_lineage(grown.select("node").distinct().join(classes, "node").select("node", "one", "short", regions))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text"
    ).join(wanted.select("one.id", "one.text_hash", "node"), ["id", "text_hash"])
    sets = cut_lineage(texts.select("node", "text").mapInArrow(_sets, "f1 bigint, shingles array<bigint>").dropDuplicates(["f1"]))

    pairs = cut_lineage(_likely(led(grown), classes))
    ends = pairs.select(F.col("a").alias("node"), "alike", "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "alike", "a", "b"))
    best = ends.groupBy("node").agg(F.max(F.struct("alike", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    links = cut_lineage(_confirmed(best, sets))
    roots = components(links)
    for reach in NEIGHBOURS:
        more = _across(pairs, roots).unionByName(neighbours(grown, wanted, roots, reach)).distinct()
        links = cut_lineage(links.unionByName(_confirmed(more, sets)))
        pairs, roots = pairs.limit(0), components(links)
    links = cut_lineage(links.unionByName(rest(grown, wanted.select("node", "short", "regions"), sets, roots)))
    roots = components(links)

    rooted = classes.select("node", "id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id")
    rooted = cut_lineage(rooted)
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = rooted.join(smallest, "root").select(F.col("node").alias("f1"), "component_id")
    placed = rows.select("doc_id", "text_hash", "n_shingles", "f1").join(of_class, "f1", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with their columns, one of each component; of repeated rows with a text, one."""
    held = groups(docs).where("kept").groupBy(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text_hash"
    ).agg(F.max("n_shingles").alias("n"))
    rows = packed(docs).select(
        "doc", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("doc.text").alias("text_hash")
    )
    nth = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(F.lit(0)))
    return rows.join(held, ["id", "text_hash"]).withColumn("nth", nth).where("nth = 1 or n = 0").select("doc.*")
