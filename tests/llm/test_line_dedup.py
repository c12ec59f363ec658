import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from tables import documents  # noqa: F401

from lanternfish.llm import line_dedup


def run(docs):
    return {r["doc_id"]: r["text"] for r in line_dedup.report(docs).collect()}


def line(rng, n=8):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_shared_passage_goes_from_later_documents(documents):
    rng = random.Random(1)
    passage = [line(rng) for _ in range(14)]
    long = line(rng, 60)
    own = [[line(rng) for _ in range(6)] for _ in range(12)]
    rows = [(i, "\n".join(own[i][: i % 6] + passage + [long] + own[i][i % 6 :])) for i in range(12)]
    got = run(documents(rows))
    assert got[0] == rows[0][1]
    for i in range(1, 12):
        left = got[i].split("\n")
        assert long not in left
        assert set(own[i]) <= set(left)  # nothing of its own is lost
        assert len(set(left) & set(passage)) <= 8  # only chunks that reach over the ends of the passage stay


def test_defined_cases(documents):
    text = "one two\nthree four\n" * 4 + "end"
    rows = [(1, None), (2, ""), (3, text), (None, text), (4, text), (4, text), (5, "\n\n\n"), (6, "a b\n"), (7, "x\n" * 30000)]
    docs = documents(rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] is None and texts[2] == "" and texts[5] == "\n\n\n" and texts[6] == "a b\n"
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    again = [r["text"] for r in got if r["doc_id"] == 4]
    assert again[0] == again[1]
    assert len(texts[None]) <= len(texts[3])
    assert line_dedup.report(docs.where("false")).count() == 0


def test_removed_text_is_elsewhere(documents):
    rng = random.Random(5)
    pool = [line(rng, rng.choice((2, 5, 45))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    got = run(documents(rows))
    before, after = "\n".join(t for _, t in rows).split("\n"), "\n".join(t for _, t in sorted(got.items())).split("\n")
    assert set(before) == set(after) - {""} | set(before) & {""}  # every line is left somewhere
    longs = [x for x in after if len(x.split()) >= line_dedup.LONG_LINE]
    assert len(longs) == len(set(longs))


def test_wrapped_passages_of_a_few_lines_go_whole(documents):
    rng = random.Random(6)
    passages = [[line(rng, -(-60 // n)) for _ in range(n)] for n in (2, 3, 4, 5, 6) for _ in range(12)]
    short = [line(rng, 8), line(rng, 9)]
    rows, own = [], {}
    for k, passage in enumerate(passages):
        for i in (2 * k, 2 * k + 1):
            own[i] = [line(rng) for _ in range(4)]
            gap = [""] if k % 3 == 0 else []
            rows.append((i, "\n".join(own[i][:2] + passage[:1] + gap + passage[1:] + own[i][2:])))
    got = run(documents(rows + [(1000, "\n".join([line(rng, 3), *short, line(rng, 3)])), (1001, "\n".join([line(rng, 4), *short]))]))
    for k, passage in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1]
        assert got[2 * k + 1].split("\n") == own[2 * k + 1]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_force(rows, weigh):
    """Cleaned texts by the rules of the docstring; weigh: hash of a line's bytes."""
    order = sorted({(1 << 63 if d is None else d, signed(xxhash.xxh64(t.encode(), seed=42).intdigest()), d, t) for d, t in rows if t is not None}, key=lambda x: x[:2])
    first, out = {}, {}
    blank = re.compile(r"^[\x20\x09-\x0D]*$")
    n_words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    for _, _, doc_id, text in order:
        lines = text.split("\n")
        hashes, long = [weigh(x) for x in lines], [n_words(x) >= line_dedup.LONG_LINE for x in lines]
        ends = []
        for i, h in enumerate(hashes):
            before = hashes[i - 1] if i else 0
            rolled = ((before << 1) | (before >> 63)) & ((1 << 64) - 1)
            if long[i] or i + 1 == len(lines) or long[i + 1] or (rolled ^ h) & ((1 << line_dedup.CUT_BITS) - 1) == 0:
                ends.append(i)
        filled = [i for i, x in enumerate(lines) if not blank.match(x)]
        gone, own = set(), {}
        for a, b in zip([0] + [e + 1 for e in ends], ends):
            if sum(a <= i <= b for i in filled) >= 2 or any(long[a : b + 1]):
                key = ("chunk", tuple(hashes[a : b + 1]))
                place = own.get(key) or first.get(key)
                if place and place[0][place[1] : place[1] + b - a + 1] == lines[a : b + 1]:
                    gone |= set(range(a, b + 1))
                first.setdefault(key, (lines, a))
                own[key] = (lines, a)
        links = []
        for q, (a, b) in enumerate(zip(filled, filled[1:])):
            key = ("pair", hashes[a], hashes[b], b - a)
            place = own.get(key) or first.get(key)
            if place:
                links.append((q, a, b, *place))
            first.setdefault(key, (lines, a, q))
            own[key] = (lines, a, q)
        while links:
            k = 1
            while k < len(links) and links[k][0] == links[k - 1][0] + 1 and links[k][5] == links[k - 1][5] + 1 and links[k][3] is links[k - 1][3]:
                k += 1
            (_, a, _, there, at, _), b = links[0], links[k - 1][2]
            links = links[k:]
            run = lines[a : b + 1]
            if n_words("\n".join(run)) >= line_dedup.RUN_WORDS and there[at : at + len(run)] == run:
                gone |= set(range(a, b + 1))
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return sorted((str(d), None if t is None else out[d, t]) for d, t in rows)


def some_rows(seed):
    rng = random.Random(seed)
    pool = [line(rng, rng.choice((1, 3, 7, 12, 45))) for _ in range(60)] + ["", " \t"]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for k in range(80):
        text = [rng.choice(pool) if rng.random() < 0.1 else line(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(0, 8))]
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(0, len(text) + 1) : 0] = rng.choice(passages)
        rows.append((k // 2 if k % 7 == 0 else k, "\n".join(text)))
    return [*rows, (None, rows[3][1]), (5, rows[5][1]), (1000, rows[9][1]), (1001, "x y z\n" * 40), (1002, None), (1003, "")]


def result(docs):
    return sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.report(docs).collect())


@pytest.mark.parametrize("few", [line_dedup.FEW_NAMES, 0])
def test_against_brute_force(documents, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_NAMES", few)
    rows = some_rows(31)
    assert result(documents(rows)) == brute_force(rows, lambda x: xxhash.xxh64(x.encode(), seed=42).intdigest())


def test_equal_hashes_of_other_lines_take_nothing_away(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "_hash", lambda x: F.length(x).cast("long") % 3)
    rows = some_rows(32)
    got = result(documents(rows))
    assert got == brute_force(rows, lambda x: len(x) % 3)
    assert {x for _, t in rows if t for x in t.split("\n")} <= {x for _, t in got if t for x in t.split("\n")} | {""}
