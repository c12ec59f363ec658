import random
import re

import numpy as np
import pytest
from tables import documents  # noqa: F401

from lanternfish.llm import prefix_join


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    ws = words(text)
    return {tuple(ws)} if 0 < len(ws) < 4 else {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)}


def expected(rows):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((d if d is not None else -1, len(s), least.get(find(k), -1) if s else (-1 if d is None else d)) for k, ((d, _), s) in enumerate(zip(rows, sets)))


def found(df):
    rows = prefix_join.groups(df).collect()
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in rows)


def some_texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 9, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            cut = rng.randint(0, len(copy) // 8)
            out.append(rng.choice([" ", "\n ", "\t"]).join(copy[cut:]).title())
    return out


@pytest.mark.parametrize("piece", [prefix_join.PIECE, 3])
def test_against_brute_force(spark, documents, monkeypatch, piece):
    monkeypatch.setattr(prefix_join, "PIECE", piece)
    texts = some_texts(21)
    rows = [*enumerate(texts), (900, None), (901, " \n"), (None, texts[0]), (902, texts[0]), (902, texts[5]), (None, "quite alone here with five")]
    assert found(documents(rows)) == expected(rows)


def test_chain_of_links_reaches_all(spark, documents):
    base = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join([*(f"x{j}" for j in range(6 * k)), *base[6 * k :]])) for k in range(12)]
    got = found(documents(rows))
    assert got == expected(rows)
    assert {r[2] for r in got} == {0}


def test_all_rounds_together_find_what_the_last_alone_finds(spark, documents, monkeypatch):
    rows = list(enumerate(some_texts(22, 25)))
    monkeypatch.setattr(prefix_join, "in_one_list", lambda members, classes, sets, roots, salt: members.sparkSession.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(prefix_join, "PIECE", 2)
    assert found(documents(rows)) == expected(rows)


def test_empty_table_and_very_long_texts(spark, documents):
    assert found(documents([])) == []
    long = " ".join(f"word{k % 997}x{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short"), (4, "SHORT")]
    assert [r[2] for r in found(documents(rows))] == [1, 1, 3, 3]


def test_filters_are_bounds():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 19, 20, 21, 100, 333):
        assert prefix_join.prefix_length(n) == n - (85 * n + 99) // 100 + 1
    x = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    bits = lambda s: np.frombuffer(prefix_join._bits(s), np.uint64)
    for changed in range(0, 60, 5):
        y = np.unique(np.concatenate((x[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64))))
        both = np.stack((bits(x), bits(y)))
        may = len(prefix_join._may_link(both, np.array([len(x), len(y)]), 0, np.array([1]))) == 1
        assert may or not prefix_join._linked(x, y)


def test_hot_shingles_lose_no_link(spark, documents, monkeypatch):
    classes = prefix_join.frequency_classes
    monkeypatch.setattr(prefix_join, "frequency_classes", lambda docs: (classes(docs)[0], 2))
    monkeypatch.setattr(prefix_join, "PIECE", 4)
    rows = list(enumerate(some_texts(23, 20)))
    assert found(documents(rows)) == expected(rows)


def test_large_sets_are_checked_by_pairs(spark, documents, monkeypatch):
    monkeypatch.setattr(prefix_join, "FEW_NAMES", 0)
    rng = random.Random(24)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2500)]
    rows = [(0, " ".join(base)), (1, " ".join(base[40:])), (2, " ".join([*base[:1250], *(f"v{k}" for k in range(1250))])), (3, " ".join(base[600:]))]
    rows += [(k, " ".join(rng.choice(base) for _ in range(2300))) for k in range(4, 12)]
    assert found(documents(rows)) == expected(rows)
