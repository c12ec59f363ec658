import random
import re
from collections import Counter

import numpy as np
import pytest

from lanternfish.llm import collocations, hashes

SCHEMA = "doc_id bigint, text string, lang string, words string, n bigint"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def expected(docs, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[(lang or "und"), tuple(ws[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = {}
    for (lang, ws), a in found.items():
        inside = any(
            other == lang and len(longer) > len(ws) and 100 * b >= 100 * a and any(longer[i : i + len(ws)] == ws for i in range(len(longer)))
            for (other, longer), b in found.items()
        )
        if inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], n[lang]))
    return {
        (lang, rank, phrase.decode(), -a, left, right, n_, -score)
        for lang, some in rows.items()
        for rank, (score, a, phrase, left, right, n_) in enumerate(sorted(some)[:top], 1)
    }


def found(spark, docs, least, **more):
    df = spark.createDataFrame([(k, text, lang, "x", k) for k, (lang, text) in enumerate(docs)], SCHEMA)
    rows = collocations.collocations(df, least, **more).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def some_docs(seed, n=80):
    rng = random.Random(seed)
    words = "the of a new York city émile b c-d É 'x \xa0 \x00z".split(" ")
    docs = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "fr", None, "und"]), text + "over the top of it. " * (k % 3)))
    return [*docs, docs[0], docs[0], ("en", None), (None, ""), ("fr", " . ,"), ("en", "one two three four five six " * 400)]


def test_against_brute_force(spark):
    docs = some_docs(12)
    assert found(spark, docs, 8) == expected(docs, 8)


def test_first_of_each_language_and_blocks_of_any_size(spark, monkeypatch):
    docs = some_docs(13, 40)
    assert found(spark, docs, 5, top=7) == expected(docs, 5, 7)


def test_empty_tables(spark):
    assert found(spark, [], 2) == set()
    assert found(spark, [("en", None), (None, "one")], 2) == set()


@pytest.mark.parametrize("least", [1, 3, 40])
def test_quicksort_counts_all_heads(least):
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 5, (500, 5)).astype(np.uint64)
    for k, width in enumerate(rng.integers(1, 6, 500)):
        rows[k, width:] = 0
    counts = rng.integers(1, 4, 500)
    heads = Counter()
    for row, n in zip(rows.tolist(), counts.tolist()):
        for m in range(2, 6):
            if row[m - 1]:
                heads[tuple(row[:m])] += n
    got = {tuple(w.tolist()): n for w, n in collocations.frequent(rows, counts, least, 2)}
    assert got == {w: n for w, n in heads.items() if n >= least}


def test_long_texts_are_cut_between_pieces_only():
    text = "ab cd. " * 1000
    at = collocations._cut(text, 100)
    assert text[at - 1] == "." and at <= 100
    assert collocations._cut("ab " * 1000, 100) is None
    rows = [r for part in hashes.slices(iter([]), collocations._cut) for r in part]
    assert rows == []


def test_words_hash_alike_wherever_they_stand():
    words = hashes.Words(["one two", "", "Two  one three two"], collocations._KIND)
    spelled = [words.spelled(k) for k in range(len(words))]
    assert spelled == [b"one", b"two", b"two", b"one", b"three", b"two"]
    assert len(set(words.hashes.tolist())) == 3 and words.hashes[0] == words.hashes[3]
    assert words.text.tolist() == [0, 0, 2, 2, 2, 2]
