import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from tables import SMALL, documents  # noqa: F401

from lanternfish.llm import queries, quality_rules


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    facts = len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    return (*facts, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def texts():
    rng = random.Random(3)
    some = [" ".join(rng.choice("ab cd ef gh # é  \U0001f600x".split(" ")) for _ in range(n)) for n in (1, 2, 3, 4, 49, 50, 51, 400)]
    long = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(900))
    return [None, "", " \t\n\x0b\f\r ", "a", "a a a", "a a a a", "x\x1cy z", *some, long, "same line\n" * 3 + "same line", "a b c " * 40, long]


def test_facts_match_brute_force(documents):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(rows + [(3, "a")])).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), i


def test_order_does_not_change_the_verdict(documents):
    docs = documents(list(enumerate(texts())))
    from lanternfish.llm.common import packed

    df = packed(docs).select("doc", F.col("doc.text").alias("text"))
    rules = list(quality_rules.BASE + quality_rules.MORE)
    kept = lambda order: {r[0] for r in quality_rules.cascade(df, order).where("rejected_by is null").select("doc.doc_id").collect()}
    assert kept(rules) == kept(rules[::-1])
    whole = quality_rules.keep_good(docs)
    assert whole.columns == docs.columns and {r["doc_id"] for r in whole.collect()} == kept(rules)


def test_cheap_rejections_come_first():
    e = quality_rules.Estimate
    rules = quality_rules.BASE
    ranked = sorted([e(rules[1], 2.0, 0.5), e(rules[0], 0.1, 0.2)], key=lambda x: -x.worth)
    assert ranked[0].rule is rules[0]


def test_empty_table(documents):
    assert quality_rules.judge(documents([(1, "x")]).where("false")).count() == 0


def test_same_as_sql(spark):
    verdict = compare(spark, connect(SMALL), "op3", queries.QUERIES["op3_quality_rules"], queries.SQL_TWINS["op3_quality_rules"], SMALL)
    assert verdict.startswith("ok"), verdict


def test_a_filter_on_the_verdict_does_not_repeat_the_facts(spark):
    """The plan with a filter is about as long as the one without, whatever the order of the rules."""
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    judged = quality_rules.judge(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for condition in ("kept", "not base_failed", "rejected_by = 'symbols'", "n_repeat_words > 3"):
        assert plan(judged.where(condition)) < 1.5 * plan(judged) + 1000, condition
    assert judged.where("kept").count() == sum(r["kept"] for r in judged.select("kept").collect())


def test_costs_are_those_of_facts_not_known_yet(documents):
    docs = documents([(k, f"word{k} " * 60) for k in range(50)])
    found = {e.rule.name: e for e in quality_rules.estimate(docs, quality_rules.BASE, known=("n_words",))}
    assert found["few_words"].rejected == 0 and found["few_words"].cost <= found["repeated_words"].cost + 0.05
