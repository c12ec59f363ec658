import math
from collections import defaultdict

import pytest

from tables import documents  # noqa: F401

from lanternfish.llm import mixing


def expected(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        rate = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if rate * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, rate * weight[s]) for s in order}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("n", [[40, 1, 0, 90, 3], [5], [0, 0], [300, 300, 300, 2, 2, 2]])
def test_targets_are_met(documents, n):
    names = [None, "b", "a", "Z", "é", "c"]
    rows = [(None if i == 3 else 1000 * k + i, "w " * (1 + (i * 7) % 23) * 5, names[k]) for k, m in enumerate(n) for i in range(m)]
    rows += [(9, None, names[0]), (8, " ", names[0]), (8, " ", names[0]), (7, "long " * 9000, "b"), (7, "long " * 9000, "b")]
    docs = documents(rows)
    got = mixing.mix(docs, block=64).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = expected(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 * 4, (s, taken[s], want[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block=64).collect()))


def test_rows_are_taken_as_planned(documents):
    docs = documents([(i, f"a{i}  b\tc " * (i % 9), f"s{i % 4}") for i in range(200)] + [(5, "a5  b\tc " * 5, "s1")])
    words = sum(r["taken"] for r in mixing.mix(docs, block=32).collect())
    out = mixing.take(docs, block=32)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(r["text"].split()) for r in rows) == words
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in rows)


def test_empty(documents):
    docs = documents([(1, "x", "s")]).where("false")
    assert mixing.mix(docs).count() == 0 and mixing.take(docs).count() == 0


def test_schedule_is_spread_evenly(spark):
    shares = spark.createDataFrame([("a", 1000, 600.0), ("b", 1000, 300.0), (None, 1000, 100.0)], "source string, source_size long, target double")
    rows = [r["source"] for r in mixing.schedule(spark, shares, 1).orderBy("slot").collect()]
    for n in (50, 200, 1000):
        assert abs(rows[:n].count("a") - 0.6 * n) <= 4 and abs(rows[:n].count(None) - 0.1 * n) <= 4
