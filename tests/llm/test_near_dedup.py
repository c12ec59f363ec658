import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tables import documents  # noqa: F401

from lanternfish.llm import near_dedup, shingles


def sets_of(texts):
    out = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        if words:
            out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return out


def brute(texts):
    sets, root = sets_of(texts), {i: i for i, _ in texts}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root, sets


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    texts, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        for c in range(rng.choice((1, 1, 2, 8))):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((n, " ".join(copy)))
            n += 1
    return texts + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (906, "word " * 30000)]


def star(rng, first):
    """A text and others that are like it, but not like most of each other."""
    base = [f"b{k}" for k in range(200)]
    texts = [(first, " ".join(base))]
    for i in range(1, 90):
        copy = list(base)
        for k in rng.sample(range(200), 5):
            copy[k] = f"n{i}_{k}"
        texts.append((first + i, " ".join(copy)))
    return texts


def test_same_components_as_brute_force(documents):  # noqa: F811
    texts = corpus() + star(random.Random(3), 2000)
    root, sets = brute(texts)
    for r in near_dedup.groups(documents(texts)).collect():
        assert r["component_id"] == root[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == len(sets.get(r["doc_id"], ()))


def test_repeated_rows_and_null_ids(documents):  # noqa: F811
    text = " ".join(f"x{k}" for k in range(40))
    docs = documents([(5, text), (5, text), (None, text), (7, text + " y"), (None, "alone here"), (8, None), (8, None)])
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["5", "8", "8", "None"]
    assert near_dedup.keep_one(docs.where("false")).count() == 0


def test_components_of_stars_and_chains(spark):
    n = 12
    links = [(100, k) for k in range(n)] + [(1000 + k, 1001 + k) for k in range(n)]
    roots = dict(near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert len(set(roots.values())) == 2 and len(roots) == 2 * n + 2


def test_hashes_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", None, "é ß  x", "p q r s t u"]
    together = shingles.shingle_sets(texts)
    for t, s in zip(texts, together):
        assert (shingles.shingle_sets([t])[0] == s).all()


def test_neighbours_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    n = 90
    piece, node = np.sort(rng.integers(0, 4, n)), rng.permutation(n)
    size, root = rng.integers(6, 10, n), rng.integers(0, 60, n)
    short = np.concatenate((rng.integers(0, 2, (n, shingles.HASHES)), np.ones((n, shingles.BINS))), axis=1).astype(np.uint8)
    columns = [*map(pa.array, (piece, node, size, root)), pa.array([s.tobytes() for s in short], pa.binary())]
    whole = pa.RecordBatch.from_arrays(columns, ["piece", "node", "n", "root", "short"])

    def pairs(width, reach):
        parts = (whole.slice(k, width) for k in range(0, n, width))
        rows = [r for b in near_dedup._met(reach)(parts) for r in b.to_pylist()]
        return {(r["a"], b) for r in rows for b in r["others"]}

    for reach in (1, 7):
        wanted = {
            tuple(sorted((int(node[i]), int(node[j]))))
            for i in range(n)
            for j in range(i + 1, min(i + reach + 1, n))
            if piece[i] == piece[j] and root[i] != root[j] and min(size[i], size[j]) >= 0.75 * max(size[i], size[j])
            and 2 * (short[i] == short[j])[: shingles.HASHES].sum() >= shingles.HASHES
        }
        assert wanted and all(pairs(width, reach) == wanted for width in (1, 5, 40, n))
    assert list(near_dedup._met(3)(iter(()))) == []


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    far = 0
    for n in (1, 2, 3, 5, 9, 30, 80, 200, 700, 5000):
        for _ in range(150):
            values = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))
            common = 3 * n // 4
            rest = (n - common) // 2
            near = np.sort(values[rng.permutation(len(values))[:n]])
            order = rng.permutation(n)
            x, y = np.sort(near[order[: common + rest]]), np.sort(near[np.concatenate((order[:common], order[common + rest :]))])
            similar = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            sketches = [np.frombuffer(shingles.sketch(s), np.uint8)[None] for s in (x, y)]
            if len(x) and len(y) and similar >= 0.75:
                assert shingles.may_be_similar(*sketches, np.array([len(x) + len(y)]), 0.75)[0]
            half = [np.frombuffer(shingles.sketch(np.sort(values[a])), np.uint8)[None] for a in (slice(0, n), slice(n // 3, n + n // 3))]
            far += n >= 30 and not shingles.may_be_similar(*half, np.array([2 * n]), 0.75)[0]
    assert far > 0.5 * 5 * 150


def test_texts_with_a_deep_common_prefix_meet_in_large_regions(spark):
    rng = np.random.default_rng(8)
    crowd, pairs = 3000, 30
    sigs = rng.integers(0, 1 << 31, (crowd, shingles.HASHES))
    sigs[:, : shingles.LEAST_DEPTH] = 7  # one region of all classes, in the first order
    places = rng.permutation(crowd)[: 2 * pairs].reshape(pairs, 2)
    for i, j in places:
        sigs[j, :6] = sigs[i, :6]
    rows = [(k, 100, [int(x) for x in v]) for k, v in enumerate(sigs)]
    grown = near_dedup.forest(spark.createDataFrame(rows, "node bigint, n bigint, sig array<int>")).where(f"crowd > {near_dedup.PIECE}")
    short = bytes(shingles.HASHES) + b"\1" * shingles.BINS
    known = grown.selectExpr("node").distinct().withColumn("short", F.lit(short))
    roots = spark.createDataFrame([], "node bigint, root bigint")
    found = {(r["a"], r["b"]) for r in near_dedup.neighbours(grown, known, roots, near_dedup.NEIGHBOURS[-1]).collect()}
    assert {tuple(sorted(map(int, p))) for p in places} <= found


def test_texts_linked_with_few_members_of_a_large_region(spark):
    rng = np.random.default_rng(9)
    size, far = 1200, 40
    regions = [[int(x) for x in rng.integers(0, 1 << 60, shingles.TREES)] for _ in range(size + far)]
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    common = lambda n: np.concatenate((base[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)))
    sets = [np.unique(common(330)) for _ in range(size)]  # about 0.7 of all others
    for k in range(far):  # each like one of the group alone
        own = sets[k * 25].copy()
        own[rng.permutation(400)[:40]] = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        sets.append(np.unique(own))
    tops = [{"node": k, "n": len(s), "crowd": size + far, "d3": 5} for k, s in enumerate(sets)]
    facts = []
    for k, s in enumerate(sets):
        regions[k][3] = 5
        facts.append((k, shingles.signature(s).astype(np.uint8).tobytes() + shingles.sketch(s), regions[k]))
    rows = spark.createDataFrame([tuple(x.values()) for x in tops], "node bigint, n bigint, crowd bigint, d3 bigint")
    known = spark.createDataFrame(facts, "node bigint, short binary, regions array<bigint>")
    full = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in enumerate(sets)], "f1 bigint, shingles array<bigint>")
    roots = spark.createDataFrame([(k, 0) for k in range(size)], "node bigint, root bigint")
    found = {(r["a"], r["b"]) for r in near_dedup.rest(rows, known, full, roots).collect()}
    assert {b for _, b in found} == set(range(size, size + far))
    for a, b in found:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both)
    settled = spark.createDataFrame([(k, 0) for k in range(size + far)], "node bigint, root bigint")
    assert near_dedup.rest(rows, known, full, settled).count() == 0
