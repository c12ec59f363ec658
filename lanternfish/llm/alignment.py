"""Cheapest edits that turn a sequence of role letters into an alternating one: s?(ua)+ or nothing.

Wagner-Fischer alignment against every feasible target length. All targets end alike, so the cost tables of all lengths
are one table over (rows done, letters still to come); Ukkonen bands, from the cost of a plain repair, bound the cells of
a row. Lengths of equal cost are told apart by their backtraced audits: one letter an edit (D delete, I insert, K keep,
R rerole), the ASCII-least audit wins.

A long sequence is solved in blocks. A block is solved for every pair of states before and after it; insertions stand
before a row of their block, those after the last row belong to the last block. So every audit of a block but the last
ends with an edit of the same row, none is the beginning of another one, and the least audit of the whole is found by
comparing the audits of its blocks.
"""

from __future__ import annotations

import numpy as np

# Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: What has been written so far: nothing, the leading s only, a last u, a last a.
STATES = ("", "s", "u", "a")
#: The sequence ends well in these.
ENDS = ("", "a")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}

_FAR = np.int64(1) << 40


class Rows:
    """Letters of the roles (other letters can't be kept), rows that must go, rows that cost one more when they stay."""

    def __init__(self, letters: str, must_go: list[bool], truncated: list[bool]):
        self.letters, self.must_go, self.truncated = letters, must_go, truncated

    def __len__(self) -> int:
        return len(self.letters)


def plain_cost(rows: Rows, state: str, last: bool) -> int:
    """Cost of one way to repair: never delete what may stay, insert where the other role is due."""
    cost, kept = 0, False
    for letter, gone, short in zip(rows.letters, rows.must_go, rows.truncated):
        if gone:
            cost += DELETE
            continue
        cost += TRUNCATED * short
        kept = True
        if letter == "s" and state == "":
            state = "s"
        elif letter == NEXT[state]:
            state = letter
        elif letter in "ua":
            cost += INSERT
            state = letter
        else:
            cost += REROLE
            state = NEXT[state]
    if last and state not in ENDS:
        cost += INSERT * (2 if state == "s" else 1)
    # a block may have to end in the other letter: its last row that stays is reroled behind an insertion
    return cost if last or not kept else cost + INSERT + REROLE


class Table:
    """Costs of turning the rows from i on into the last m letters of an alternating sequence that ends in `end`."""

    def __init__(self, rows: Rows, end: str, last: bool, budget: int):
        self.rows, self.end, self.last = rows, end, last
        n = len(rows)
        gone = np.concatenate(([0], np.cumsum(np.array(rows.must_go, np.int64))))
        self.low = np.zeros(n + 1, np.int64)
        self.costs: list[np.ndarray] = [np.empty(0, np.int64)] * (n + 1)
        for i in range(n, -1, -1):
            # band: deletions that the rows and the length ask for, and the insertions that follow from them
            left, must = n - i, int(gone[n] - gone[i])
            spare = budget - DELETE * int(gone[i])
            low = max(0, left - spare // DELETE)
            high = left - must + max(spare - DELETE * must, 0) // INSERT
            if i == n and not last:
                high = 0
            m = np.arange(low, max(high, low) + 1)
            if i == n:
                cost = INSERT * m
            else:
                cost = self._of(i + 1, m) + DELETE
                if not rows.must_go[i]:
                    same = self._due(m) == rows.letters[i]
                    stay = self._of(i + 1, m - 1) + np.where(same, 0, REROLE) + TRUNCATED * rows.truncated[i]
                    cost = np.minimum(cost, stay)
                cost = np.minimum.accumulate(cost - INSERT * m) + INSERT * m
            self.low[i], self.costs[i] = low, cost

    def _due(self, m: np.ndarray) -> np.ndarray:
        other = "u" if self.end == "a" else "a"
        return np.where(m % 2 == 1, self.end, other)

    def _of(self, i: int, m: np.ndarray) -> np.ndarray:
        at = m - self.low[i]
        inside = (at >= 0) & (at < len(self.costs[i])) & (m >= 0)
        return np.where(inside, self.costs[i][np.clip(at, 0, len(self.costs[i]) - 1)], _FAR)

    def cost(self, i: int, m: int) -> int:
        at = m - self.low[i]
        return int(self.costs[i][at]) if m >= 0 and 0 <= at < len(self.costs[i]) else int(_FAR)

    def lengths(self, i: int, due: str, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths from `least` on whose first letter is `due`, and their costs; length 0 is always fit."""
        m = self.low[i] + np.arange(len(self.costs[i]))
        fit = (m >= least) & ((m == 0) | (self._due(m) == due))
        return m[fit], self.costs[i][fit]

    def audit(self, i: int, m: int) -> str:
        """The ASCII-least edits of that cost."""
        rows, out = self.rows, []
        while i < len(rows) or m:
            cost = self.cost(i, m)
            if i < len(rows) and self.cost(i + 1, m) + DELETE == cost:
                out.append("D")
                i += 1
            elif m and (i < len(rows) or self.last) and self.cost(i, m - 1) + INSERT == cost:
                out.append("I")
                m -= 1
            else:
                out.append("K" if (self.end == rows.letters[i]) == (m % 2 == 1) and rows.letters[i] in "ua" else "R")
                i, m = i + 1, m - 1
        return "".join(out)


def _least(options: list[tuple[int, object]]) -> tuple[int, str] | None:
    """The cheapest option; audits (made on demand) tell ties apart."""
    best = min((cost for cost, _ in options), default=_FAR)
    return None if best >= _FAR else (best, min(audit() for cost, audit in options if cost == best))


def _from_table(table: Table, state: str, least: int) -> list[tuple[int, object]]:
    """Options for all rows from a state; from nothing also by a leading s that is kept after deletions."""
    found = []
    for m, cost in zip(*table.lengths(0, NEXT[state], least)):
        found.append((int(cost), lambda m=m: table.audit(0, int(m))))
    if state == "":
        rows = table.rows
        for k, letter in enumerate(rows.letters):
            if letter == "s" and not rows.must_go[k]:
                for m, cost in zip(*table.lengths(k + 1, "u", max(least, 1))):
                    whole = int(cost) + DELETE * k + TRUNCATED * rows.truncated[k]
                    found.append((whole, lambda k=k, m=m: "D" * k + "K" + table.audit(k + 1, int(m))))
    return found


def solve_last(rows: Rows, states: tuple[str, ...] = STATES) -> dict[str, tuple[int, str]]:
    """For every state before the last block: cost and audit of its cheapest edits."""
    budget = max(plain_cost(rows, s, True) for s in states)
    table, out = Table(rows, "a", True, budget), {}
    for state in states:
        options = _from_table(table, state, {"": 1, "s": 2, "u": 1, "a": 0}[state])
        if state == "":
            options.append((DELETE * len(rows), lambda: "D" * len(rows)))
        out[state] = _least(options)
    return out


def solve_block(rows: Rows) -> dict[tuple[str, str], tuple[int, str]]:
    """For every state before and after a block that others follow: cost and audit, where there is a way."""
    budget, n = max(plain_cost(rows, s, False) for s in STATES), len(rows)
    out: dict[tuple[str, str], tuple[int, str] | None] = {}
    tables = {end: Table(rows, end, False, budget) for end in "ua"}
    for state in STATES:
        for end, table in tables.items():
            out[state, end] = _least(_from_table(table, state, 0 if state == end else 1))
    everything = (DELETE * n, "D" * n)
    out["", ""] = out["s", "s"] = everything
    kept = [
        (DELETE * (n - 1) + TRUNCATED * rows.truncated[k], lambda k=k: "D" * k + "K" + "D" * (n - 1 - k))
        for k in range(n)
        if rows.letters[k] == "s" and not rows.must_go[k]
    ]
    out["", "s"] = _least(kept)
    return {k: v for k, v in out.items() if v is not None}


def compose(
    blocks: list[dict[tuple[str, str], tuple[int, str]]], last: dict[str, tuple[int, str]]
) -> tuple[int, list[tuple[str, str]]]:
    """Cost, and (state before, audit) of all blocks, from nothing to a good end."""
    ahead = {state: (cost, (audit, (), state)) for state, found in last.items() if found for cost, audit in [found]}
    for ways in reversed(blocks):
        now: dict[str, tuple[int, tuple]] = {}
        for (before, after), (cost, audit) in ways.items():
            if after in ahead:
                option = (cost + ahead[after][0], (audit, ahead[after][1], before))
                now[before] = min(now.get(before, option), option)
        ahead = now
    cost, chain = ahead[""]
    parts = []
    while chain:
        parts.append((chain[2], chain[0]))
        chain = chain[1]
    return cost, parts
