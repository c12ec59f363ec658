import random
import statistics

from lanternfish.operators import outliers


def brute_force(values):
    left, out = sorted(set(values)), set()
    while len(left) >= 6:
        middle, top = statistics.median(left[-6:-1]), left[-1]
        if top < 1.5 * middle or top - middle < 500:
            break
        out.add(left.pop())
    return out


def test_one_year(spark):
    rows = [(2025, n) for n in (546, 550, 551, 552, 553, 558, 2044)]
    df = spark.createDataFrame(rows, "year int, number long")
    assert [tuple(r) for r in outliers.outlier_numbers(df, "year", "number").collect()] == [(2025, 2044)]
    stats = outliers.recovery_by_group(df, "year", "number").first()
    assert (stats["found"], stats["hidden"], stats["report_count"]) == (6, 558, 7)
    assert outliers.drop_outliers(df, "year", "number").count() == 6


def test_random_groups(spark):
    rng = random.Random(5)
    groups = {
        g: [rng.randrange(1, 900) for _ in range(rng.randrange(1, 40))]
        + [int(rng.randrange(600, 4000) * 1.7**i) for i in range(rng.randrange(0, 9))]
        for g in range(150)
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "year int, number long")
    got = {}
    for r in outliers.outlier_numbers(df, "year", "number").collect():
        got.setdefault(r["year"], set()).add(r["number"])
    want = {g: brute_force(v) for g, v in groups.items() if brute_force(v)}
    assert len(want) > 40 and got == want


def test_longest_possible_chain(spark):
    values = [1, 2, 3, 4, 5, 6]
    while values[-1] < 2**62:
        values.append(max(values[-1] + 1, int(values[-3] * 1.5) + 600))
    df = spark.createDataFrame([(1, v) for v in values + list(range(7, 1500))], "year int, number long")
    got = {r["number"] for r in outliers.outlier_numbers(df, "year", "number").collect()}
    assert got == brute_force(values + list(range(7, 1500))) and len(got) > 100


def test_unreported_across_years(spark):
    rows = [(2025, 1), (2025, 2), (2025, 2), (2024, 1), (2024, 3), (2024, 3)]
    df = spark.createDataFrame(rows, "year int, number long")
    stats = outliers.recovery_by_group(df, "year", "number").collect()
    assert sum(r["hidden"] - r["found"] for r in stats) == 1


def test_many_outliers_and_negative_numbers(spark):
    values = [-600 * k for k in range(1, 1501)]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, v) for v in (-5, -4, 0, 3, 4096, 4097, 9000)], "year int, number long")
    got = {(r["year"], r["number"]) for r in outliers.outlier_numbers(df, "year", "number").collect()}
    want = {(1, v) for v in brute_force(values)} | {(2, v) for v in brute_force([-5, -4, 0, 3, 4096, 4097, 9000])}
    assert len(want) > 1400 and got == want
