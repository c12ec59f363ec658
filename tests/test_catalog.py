import io
import re
from contextlib import redirect_stdout

import pytest

from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from lanternfish.plans import catalog

FAST = [
    "squash_text", "split_number_title", "normalize_date_flag", "holiday_flag", "moon_phase", "recovery_by_year", "nearest_k",
    "nearest_in_time", "map_clusters", "tiered_shortlist", "search_grouped", "validation_run", "merge_upsert", "next_state",
    "survivorship_merge", "kernel_zone_priors", "calendar_affinity", "page_record", "daily_briefing",
]

# rows-only: a random forest has no SQL form
NO_TWIN = {"dist_forest"}


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) - set(catalog.SQL_TWINS) == NO_TWIN
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, name):
    verdict = compare(spark, connect(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "found", "hidden", "recovery_rate", "report_count"] and df.count() > 0


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scan_reads_only_what_it_needs(spark):
    plan = plan_of(entry.queries()["scan_project_filter"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>", plan)
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["nearest_k", "reconcile_ids", "dedupe_best_record", "kernel_zone_priors", "calendar_features"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan_of(entry.queries()[name](spark, SMALL))


def test_top_per_group_is_limited_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["recovery_by_year"](spark, SMALL))
    assert plan.count("WindowGroupLimit") >= 2


def test_narrow_queries_do_not_shuffle(spark):
    for name in ("squash_text", "first_match_label", "canonicalize_date", "calendar_features", "place_from_prose", "page_title"):
        assert "Exchange" not in plan_of(entry.queries()[name](spark, SMALL)), name
