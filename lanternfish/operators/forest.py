"""Random forest over the yearly cycle, grown from counts per day and label.

The inputs of a report are functions of its day of the year and month, so a fold has under 400 distinct inputs however
many reports it has. Trees are grown on counts per (day, month, label) whose weights are resampled as drawing all reports
with replacement would: to the last split, with no limit of depth, one randomly drawn feature a split, Gini impurity.
Trees don't know of each other; a few of one fold make a task, and only the leaves that test days fall into leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Trees that are grown by one task.
TOGETHER = 5
FEATURES = 3

_LEAVES = pa.schema([("fold", pa.int32()), ("day_of_year", pa.int32()), ("month", pa.int32()), ("label", pa.string()), ("raw", pa.float64())])


def inputs(day: np.ndarray, month: np.ndarray) -> np.ndarray:
    turn = 2 * np.pi * day / 365.0
    return np.stack((np.sin(turn), np.cos(turn), month.astype(np.float64)), axis=1)


def best_split(values: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float] | None:
    """(impurity score to maximise, threshold) of the best cut of one feature; None if it has one value only."""
    by_label = np.lexsort((values, label))
    of, w = label[by_label], weight[by_label].astype(np.float64)
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    sizes = np.diff(np.append(starts, len(of)))
    running = np.cumsum(w)
    before = running - w - np.repeat(running[starts] - w[starts], sizes)
    total = np.repeat(np.add.reduceat(w, starts), sizes)
    # squares of the label counts to the left of a cut grow by this with every cell that moves there
    grows = w * (2 * before + w)
    order = np.argsort(values[by_label], kind="stable")
    v = values[by_label][order]
    ends = np.flatnonzero(v[1:] != v[:-1])
    if not len(ends):
        return None
    left = np.cumsum(grows[order])[ends]
    crossed = np.cumsum((w * total)[order])[ends]
    right = (w * total).sum() - 2 * crossed + left
    n_left = np.cumsum(w[order])[ends]
    score = left / n_left + right / (w.sum() - n_left)
    k = int(np.argmax(score))
    return float(score[k]), float((v[ends[k]] + v[ends[k] + 1]) / 2)


def leaves(
    x: np.ndarray, label: np.ndarray, weight: np.ndarray, tests: np.ndarray, rng: np.random.Generator, told: Callable[[np.ndarray, np.ndarray, np.ndarray], None]
) -> None:
    """Grow one tree on cells with a weight and report told(tests of a leaf, labels, shares); parts of the tree into which
    no test falls aren't grown."""
    spot = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
    stack = [(np.flatnonzero(weight), np.arange(len(tests)))]
    while stack:
        cells, at = stack.pop()
        if not len(at):
            continue
        cut = None
        if (label[cells] != label[cells[0]]).any() and (spot[cells] != spot[cells[0]]).any():
            for f in rng.permutation(FEATURES):
                if cut := best_split(x[cells, f], label[cells], weight[cells]):
                    break
        if cut is None:
            kinds, back = np.unique(label[cells], return_inverse=True)
            sums = np.bincount(back, weights=weight[cells])
            told(at, kinds, sums / sums.sum())
        else:
            low, tests_low = x[cells, f] <= cut[1], tests[at, f] <= cut[1]
            stack += [(cells[low], at[tests_low]), (cells[~low], at[~tests_low])]


def _grown(trees: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Some trees of one fold: label shares of its test days, summed and divided by the number of all trees."""

    def run(table: pa.Table) -> pa.Table:
        train, test = table.filter(pyarrow.compute.field("n") > 0), table.filter(pyarrow.compute.field("n") == 0)
        fold, chunk = table["fold"][0].as_py(), table["chunk"][0].as_py()
        train = train.sort_by([("day_of_year", "ascending"), ("month", "ascending"), ("label", "ascending")])
        names, label = np.unique(train["label"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        n = train["n"].to_numpy()
        days = lambda t: (t["day_of_year"].to_numpy(), t["month"].to_numpy())
        x, tests = inputs(*days(train)), inputs(*days(test))
        shares: dict[tuple[int, int], float] = {}

        def told(at: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> None:
            for t in at.tolist():
                for kind, share in zip(kinds.tolist(), p.tolist()):
                    shares[t, kind] = shares.get((t, kind), 0.0) + share

        if len(names) < 2:
            # nothing to learn: the training frequencies, as raw counts
            shares = {(t, k): float(n[label == k].sum()) for t in range(len(tests)) for k in range(len(names)) if chunk == 0}
        else:
            for tree in range(chunk * TOGETHER, min((chunk + 1) * TOGETHER, trees)):
                rng = np.random.default_rng((seed, fold, tree))
                leaves(x, label, rng.multinomial(int(n.sum()), n / n.sum()), tests, rng, told)
            shares = {k: v / trees for k, v in shares.items()}
        day, month = days(test)
        rows = [(fold, int(day[t]), int(month[t]), names[k], raw) for (t, k), raw in shares.items()]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, _LEAVES)], schema=_LEAVES)

    return run


def forest(counts: DataFrame, trees: int, seed: int) -> DataFrame:
    """(fold, day_of_year, month, label, raw): mean label shares of the leaves that the days of the held-out year fall
    into; labels of no leaf have no row. counts: (label, date, year, n)."""
    ship(counts.sparkSession)
    cells = counts.groupBy("year", F.dayofyear("date").alias("day_of_year"), F.month("date").alias("month"), "label").agg(F.sum("n").alias("n"))
    overall = cells.groupBy("day_of_year", "month", "label").agg(F.sum("n").alias("n"))
    years = cells.agg(F.sort_array(F.collect_set("year")).alias("folds"))
    held = cells.select(F.col("year").alias("fold"), "day_of_year", "month", "label", F.col("n").alias("held"))
    train = overall.join(F.broadcast(years)).select("day_of_year", "month", "label", "n", F.explode("folds").alias("fold"))
    train = train.join(held, ["fold", "day_of_year", "month", "label"], "left")
    train = train.select("fold", "day_of_year", "month", "label", (F.col("n") - F.coalesce("held", F.lit(0))).alias("n")).where("n > 0")
    test = held.select("fold", "day_of_year", "month", F.lit("").alias("label"), F.lit(0).cast("long").alias("n")).distinct()
    chunks = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TOGETHER))).alias("chunk")
    tasks = train.unionByName(test).select(F.col("fold").cast("int").alias("fold"), "day_of_year", "month", "label", "n", chunks)
    grown = tasks.groupBy("fold", "chunk").applyInArrow(_grown(trees, seed), "fold int, day_of_year int, month int, label string, raw double")
    return grown.groupBy("fold", "day_of_year", "month", "label").agg(F.sum("raw").alias("raw"))
