import hashlib
import heapq
import random
import zlib

import pytest

from lanternfish.llm import alignment, turn_repair
from lanternfish.llm.common import BLANKS

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(letters, must_go, truncated):
    """(cost, audit) by shortest paths over (rows done, last role)."""
    done, heap = {}, [(0, "", 0, "")]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done[i, s] = cost, audit
        ways = [(2, "I", i, NEXT[s])]
        if i < len(letters):
            ways.append((3, "D", i + 1, s))
            if not must_go[i]:
                ways.append((2 + truncated[i], "R", i + 1, NEXT[s]))
                if letters[i] == NEXT[s] or (letters[i] == "s" and s == ""):
                    ways.append((truncated[i], "K", i + 1, letters[i]))
        for c, e, j, t in ways:
            if len(audit) < 3 * len(letters) + 4:
                heapq.heappush(heap, (cost + c, audit + e, j, t))
    return min(done[len(letters), s] for s in ("", "a") if (len(letters), s) in done)


def test_alignment_against_shortest_paths():
    rng = random.Random(11)
    for _ in range(1500):
        letters = "".join(rng.choice("suaa?u") for _ in range(rng.randint(0, 9)))
        must = [rng.random() < 0.2 for _ in letters]
        short = [not m and rng.random() < 0.3 for m in must]
        want = cheapest(letters, must, short)
        assert alignment.solve_last(alignment.Rows(letters, must, short), ("",))[""] == want
        n = len(letters)
        edges = [0, *sorted(rng.sample(range(1, n), rng.randint(0, min(3, n - 1)))), n] if n else [0, 0]
        parts = [alignment.Rows(letters[a:b], must[a:b], short[a:b]) for a, b in zip(edges, edges[1:])]
        cost, found = alignment.compose([alignment.solve_block(p) for p in parts[:-1]], alignment.solve_last(parts[-1]))
        assert (cost, "".join(a for _, a in found)) == want


def expected(rows):
    """Contract of the query on a list of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = []
        for k, (_, role, text) in enumerate(kept):
            bare = text.rstrip(BLANKS)
            again = (role, text) in [x[1:] for x in kept[:k]]
            faults.append("blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else "")
        letters = [r[1][:1] for r in kept]
        cost, audit = cheapest(letters, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        said, state, k = [], "", 0
        for e in audit:
            role, text = ("", "") if e == "I" else kept[k][1:]
            role = {"u": "user", "a": "assistant"}[NEXT[state]] if e in "IR" else role
            if e != "D":
                said.append(f"{role}:{text}")
                state = role[0]
            k += e != "I"
        turns = {r[0] for r in kept} - {None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def found(spark, rows, span=turn_repair.SPAN):
    df = spark.createDataFrame(rows, SCHEMA)
    result = turn_repair.report(df, turn_repair.repair(turn_repair.damaged(df), span)).collect()
    assert len(result) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in result}


def some_rows(seed, convs=60):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((c, turn if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "no", " \n", "", None, "Ça va ? ", "twice said!"])))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return [*rows, (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-1, -5, "user", "x. " * 20_000)]


@pytest.mark.parametrize("span", [2, turn_repair.SPAN])
def test_against_brute_force_whole_and_in_blocks(spark, span):
    rows = some_rows(5)
    assert found(spark, rows, span) == expected(rows)


def test_real_table(spark):
    from lanternfish.llm.queries import op11_turn_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = {r["conv_id"]: tuple(r)[1:] for r in op11_turn_repair(spark, SMALL).collect()}
    assert result == expected(rows)


def test_conversation_without_rows_after_damage_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_turns_come_out_and_other_columns_do_not_disturb(spark):
    rows = [(1, 0, "user", "Hi.", 7), (1, 2, "tool", "More.", 8), (1, 3, "assistant", "So.", 9), (1, 4, "assistant", "", 10)]
    df = spark.createDataFrame(rows, SCHEMA + ", block int")
    (row,) = turn_repair.repair(df).collect()
    assert (row["audit"], row["cost"], row["gaps"]) == ("KDKD", 6, 1)
    assert [(t["edit"], t["turn"], t["role"], t["text"]) for t in row["turns"]] == [("K", 0, "user", "Hi."), ("K", 3, "assistant", "So.")]
