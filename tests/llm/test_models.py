import numpy as np
from pyspark.sql import functions as F
from tables import SMALL, documents  # noqa: F401

from lanternfish.llm import gru, one_bit_search, queries, toxicity
from lanternfish.llm.common import table


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for q, x in ok:
        scored = sorted((-float((x * v).sum()), i) for i, v in ok if i != q and len(v) == len(x))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.5, 2)).tolist()) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [None] + [1.0] * 15), (805, [float("inf")] * 16), (None, rows[0][1]), (806, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    rows = [(r["id"], None if r["vector"] is None else list(r["vector"])) for r in df.collect()]
    want = brute(rows, 20)
    got = {}
    for r in one_bit_search.nearest(df, df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    # a vector without partners of its length gets no rows
    assert set(got) == {q for q, w in want.items() if w}
    hits = [len(set(want[q]) & set(a.values())) / len(want[q]) for q, a in got.items()]
    assert np.mean(hits) > 0.98 and min(hits) >= 0.9
    assert [got[3][k] for k in sorted(got[3])] == want[3]
    assert one_bit_search.nearest(df.where("false"), df).count() == 0


def test_codes_estimate_inner_products():
    rng = np.random.default_rng(1)
    x, q = (one_bit_search.units(rng.standard_normal((n, 64)))[0] for n in (3000, 20))
    turn = one_bit_search.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, correction = one_bit_search.encode(x, turn)
    assert bits.shape == (3000, 8) and bits.dtype == np.uint8
    guess, error = one_bit_search.estimate(bits, correction, q @ turn.T, 3.0)
    true = q @ x.T
    assert abs((guess - true).mean()) < 0.01 and (abs(guess - true) <= error).mean() > 0.98


def test_recall_on_the_table(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, SMALL, "embeddings").collect()]
    want = brute(rows, 20)
    got = {}
    for r in queries.QUERIES["op8_one_bit_search"](spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert np.mean([len(set(want[q]) & set(a)) / len(want[q]) for q, a in got.items()]) >= 0.9


def test_gradients():
    rng = np.random.default_rng(2)
    net = gru.Network({"a": 1, "b": 2}, np.array([1.0, -1.0], np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, gru.WORD_SIZE + gru.CHAR_SIZE))
    windows = np.array([[0, 1, 2, 3], [4, 2, -1, -1]])
    loss = lambda x: float(net.forward(net.gates(x), windows) @ np.array([1.0, -2.0]))
    _, kept = net.forward(net.gates(x), windows, keep=True)
    grads, dx = net.backward(x, windows, kept, np.array([1.0, -2.0]))
    for name in ("Wf", "Ub", "cf", "attend", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        kept_value = net.p[name][at]
        net.p[name][at] = kept_value + 1e-3
        up = loss(x)
        net.p[name][at] = kept_value - 1e-3
        down = loss(x)
        net.p[name][at] = kept_value
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, name
    step = np.zeros_like(x)
    step[2, 1] = 1e-3
    assert abs((loss(x + step) - loss(x - step)) / 2e-3 - dx[2, 1]) < 2e-3


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        starts = gru.window_starts(n)
        covered = {w for s in starts for w in range(s, min(s + gru.WINDOW, n))}
        assert covered == set(range(n)) and (n > 0) == (len(starts) > 0)


def test_held_out_accuracy_and_defined_cases(spark, documents):  # noqa: F811
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    net = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, net).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    found = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert found > 0.7 and wrong < 0.02  # about a fifth of the labels are noise
    odd = [(1, None), (2, ""), (3, " \n"), (None, "idiot"), (4, "word " * 30000), (4, "word " * 30000), (5, "x" * 100000)]
    got = toxicity.score(documents(odd), net).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    late = "good " * 5000 + "idiot moron scum worthless trash " + "good " * 17
    assert toxicity.score(documents([(1, late)]), net).first()["predicted"] == 1
    assert toxicity.score(documents(odd).where("false"), net).count() == 0


def test_held_out_fold(spark):
    import zlib

    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
