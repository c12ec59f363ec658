"""Seasonality, backtest and briefing queries. Labels are zones of spots unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive, backtest, briefing, recency, seasonal, series, zones
from ..session import cut_lineage
from . import reports, scalars, views
from .registry import query, table

# ---------------------------------------------------------------- inputs


def zone_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Reports per (zone, date), written out.

    One pass over the reports counts them per (spot, date). Spot totals, zones and everything after
    that come from these counts.
    """
    per_spot = cut_lineage(
        views.finds_core(spark, folder)
        .groupBy("spot", F.col("date_found").alias("date"))
        .agg(F.count("*").alias("n"))
    )
    totals = per_spot.groupBy("spot").agg(F.sum("n").alias("reports"))
    members = zones.zone_members(totals, views.spots(spark, folder), "spot")
    zoned = zones.label_to_zone(per_spot, members, "spot")
    return cut_lineage(
        zoned.groupBy(F.col("zone").alias("label"), "date")
        .agg(F.sum("n").alias("n"))
        .withColumn("year", F.year("date"))
    )


def place_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Reports per (place, date), written out."""
    return cut_lineage(seasonal.label_dates(views.finds(spark, folder), "place", "date_found"))


ZF = f"""{views.FINDS_CORE}, {views.SPOTS}, {reports.MEMBERS},
zf as (select m.zone as label, f.date_found as d, year(f.date_found) as y, count(*)::bigint as n
       from finds_core f join members m on m.name = f.spot group by all)"""
PF = f"""{views.FINDS},
zf as (select place as label, date_found as d, year(date_found) as y, count(*)::bigint as n from finds group by all)"""

KERNEL = "exp(-pow(least(abs({o} - {t}), 366 - abs({o} - {t})), 2) / 882.0)"
SPINE = "spine as (select unnest(generate_series(1, 366)) as t)"

FEATURES = f"""days as (select distinct d from zf), {scalars.MOON_SQL}, {scalars.HOLIDAYS_SQL},
feat as (select d, unnest(list_filter(['weekday:' || dayname(d), case when isodow(d) >= 6 then 'weekend' end,
    case when exists (select 1 from hol where h = d and y = year(d)) then 'holiday' end,
    case when isodow(d) in (5, 6, 7, 1) and exists (select 1 from hol where h in (d - 1, d, d + 1)) then 'long_weekend' end,
    'phase:' || {scalars.PHASE_CASE}, 'bucket:' || {scalars.BUCKET_CASE}], lambda x: x is not null)) as key from moon)"""
ALL_KEYS = f"keys as (select unnest({list(seasonal.AFFINITY_KEYS)}) as key)"


def affinity_sql(by: str, source: str, name: str) -> str:
    """Affinity of ``source`` (label, d, n and maybe fold) as CTE ``name``."""
    pre = f"{by}, " if by else ""
    on = f" and r.{by} = l.{by}" if by else ""
    on_k = f" and k.{by} = l.{by}" if by else ""
    total = f"(select {pre}sum(n)::double as total from {source} group by {by})" if by else f"(select sum(n)::double as total from {source})"
    join_total = f"join {total} using ({by})" if by else f"cross join {total}"
    return f"""{name}_lab as (select {pre}label, sum(n)::double as rows from {source} group by all),
{name}_k as (select {pre}label, key, sum(n)::double as n from {source} join feat using (d) group by all),
{name}_r as (select {pre}key, sum(n)::double / any_value(total) as rate from {name}_k {join_total} group by {pre}key),
{name} as (select {"l." + by + ", " if by else ""}l.label, keys.key,
   case when l.rows > 0 and coalesce(r.rate, 0) > 0 then round((coalesce(k.n, 0) + 2 * r.rate) / (l.rows + 2) / r.rate, 4) else 1.0 end::double as ratio
 from {name}_lab l cross join keys left join {name}_r r on r.key = keys.key{on}
 left join {name}_k k on k.label = l.label and k.key = keys.key{on_k}
 where coalesce(r.rate, 0) > 0 or keys.key in ('weekend', 'holiday', 'long_weekend'))"""


PRIORS = f"""zd as (select label, dayofyear(d) as doy, sum(n)::double as n from zf group by all), {SPINE},
ks as (select label, t, sum(n * {KERNEL.format(o="doy", t="t")}) as s from zd, spine group by all),
priors as (select t as day, label, round(s / sum(s) over (partition by t), 6) as prior from ks where s > 0)"""

ACTIVITY = f"""ad as (select dayofyear(d) as doy, sum(n)::double as n from zf group by all),
asp as (select unnest(generate_series(1, 366)) as t),
ak as (select t, sum(n * {KERNEL.format(o="doy", t="t")}) as s from ad, asp group by t),
activity as (select t as day, round(least(s / avg(s) over () * 5, 10), 1) as activity from ak)"""

# ---------------------------------------------------------------- seasonality


@query(
    "seasonality_by_month",
    f"""with {views.FINDS_CORE}, c as (select month(date_found) as m, count(*) as n from finds_core group by 1),
        s as (select unnest(generate_series(1, 12)) as m)
        select s.m::integer as month, round(least(coalesce(n, 0) / ((select count(*) from finds_core) / 12.0) * 5, 10), 1)::double as score
        from s left join c using (m)""",
)
def seasonality_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal.seasonality_by_month(views.finds_core(spark, folder).select("date_found"), "date_found")


@query("kernel_activity_index", f"with {PF}, {ACTIVITY} select day::integer as day, activity from activity")
def kernel_activity_index(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal.activity_index(place_counts(spark, folder))


@query("kernel_zone_priors", f"with {ZF}, {PRIORS} select day::integer as day, label, prior from priors")
def kernel_zone_priors(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal.seasonal_priors(zone_counts(spark, folder))


@query("kernel_place_priors", f"with {PF}, {PRIORS} select day::integer as day, label, prior from priors")
def kernel_place_priors(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal.seasonal_priors(place_counts(spark, folder))


@query(
    "top3_zones",
    f"""with {ZF}, {PRIORS} select day::integer as day, label, prior, rank::integer as rank from (
        select *, row_number() over (partition by day order by prior desc, label) as rank from priors) where rank <= 3""",
)
def top3_zones(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.grouping import top_per_group

    priors = seasonal.seasonal_priors(zone_counts(spark, folder))
    return top_per_group(priors, ["day"], [F.col("prior").desc(), F.col("label").asc()], 3)


@query(
    "smoothed_ratio",
    f"""with {views.FINDS}, g as (select place, count(*) as n, count(*) filter (prio = '1-URGENT') as k from finds group by place),
        r as (select sum(k) / sum(n) as rate from g)
        select place, round((k + 2 * rate) / (n + 2) / rate, 4) as ratio from g, r""",
)
def smoothed_ratio(spark: SparkSession, folder: str) -> DataFrame:
    grouped = views.finds(spark, folder).groupBy("place").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("prio") == "1-URGENT", 1)).alias("k")
    )
    rate = grouped.agg((F.sum("k") / F.sum("n")).alias("rate"))
    return grouped.join(F.broadcast(rate)).select(
        "place", seasonal.smoothed_ratio(F.col("k"), F.col("n"), F.col("rate")).alias("ratio")
    )


@query(
    "calendar_affinity",
    f"with {ZF}, {FEATURES}, {ALL_KEYS}, {affinity_sql('', 'zf', 'aff')} select label, key, ratio from aff",
)
def calendar_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal.calendar_affinity(zone_counts(spark, folder))


def profiles(spark: SparkSession, folder: str, counts: DataFrame | None = None) -> DataFrame:
    counts = zone_counts(spark, folder) if counts is None else counts
    m = cut_lineage(reports.members(spark, folder))
    return seasonal.zone_profiles(counts, zones.zone_definitions(m), zones.top_members(m))


PROFILES = f"""{reports.ZONE_DEFS}, {FEATURES}, {ALL_KEYS}, {affinity_sql('', 'zf', 'aff')},
pm as (select label, month(d) as mo, sum(n) as n from zf group by all),
bm as (select label, string_agg(monthname(make_date(2025, mo, 1)), ',' order by rk) as best_months from (
   select *, row_number() over (partition by label order by n desc, mo) as rk from pm) where rk <= 3 group by label),
ds as (select label, sum(n)::bigint as dated, count(distinct y) as years,
   string_agg(distinct y::varchar, ',' order by y::varchar) as actual_years from zf group by label),
profiles as (select z.*, coalesce(dated, 0)::bigint as dated_support_count, coalesce(years, 0) as years,
    coalesce(actual_years, '') as actual_years, coalesce(best_months, '') as best_months, split_part(spots, ',', 1) as primary_spot
  from zone_defs z left join ds on ds.label = zone left join bm on bm.label = zone)"""


@query(
    "zone_profiles",
    f"""with {ZF}, {PROFILES} select zone, lat, lon, tags, spot_count, support_count, dated_support_count, actual_years, best_months,
        primary_spot, coalesce((select string_agg(key || '=' || printf('%.4f', ratio), ',' order by key) from aff where aff.label = zone), '')
        as affinity, (select string_agg(name || ':' || reports, ',' order by member_rank) from members m where m.zone = profiles.zone and
        member_rank <= 5) as supporting_spots from profiles""",
)
def zone_profiles(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("ratios")),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])),
    )
    return profiles(spark, folder).select(
        "zone",
        "lat",
        "lon",
        F.concat_ws(",", "tags").alias("tags"),
        "spot_count",
        "support_count",
        "dated_support_count",
        F.concat_ws(",", F.transform("actual_years", lambda y: y.cast("string"))).alias("actual_years"),
        "best_months",
        "primary_spot",
        F.coalesce(F.concat_ws(",", entries), F.lit("")).alias("affinity"),
        F.concat_ws(
            ",", F.transform("supporting_spots", lambda s: F.concat_ws(":", s["name"], s["reports"].cast("string")))
        ).alias("supporting_spots"),
    )


# ---------------------------------------------------------------- distributions and backtest

FOLDS = """folds as (select distinct y as fold from zf), labels as (select distinct label from zf),
tr as (select fold, label, d, n from folds join zf on zf.y <> folds.fold),
space as (select fold, label from folds cross join labels),
graw as (select s.fold, s.label, coalesce(sum(tr.n), 0)::double as raw from space s left join tr on tr.fold = s.fold and tr.label = s.label group by all),
dg as (select fold, label, (raw + 0.5) / sum(raw + 0.5) over (partition by fold) as p from graw)"""
MONTHS = """mctx as (select distinct y as fold, month(d) as month from zf),
mn as (select fold, month(d) as month, label, sum(n)::double as n from tr group by all),
mraw as (select c.fold, c.month, s.label, coalesce(mn.n, 0) as m_raw, sum(coalesce(mn.n, 0)) over (partition by c.fold, c.month) as seen
   from mctx c join space s on s.fold = c.fold left join mn on mn.fold = c.fold and mn.month = c.month and mn.label = s.label),
mraw2 as (select m.fold, m.month, m.label, case when seen > 0 then m_raw else g.raw end as raw from mraw m join graw g on g.fold = m.fold and g.label = m.label),
dm as (select fold, month, label, (raw + 0.5) / sum(raw + 0.5) over (partition by fold, month) as p from mraw2)"""
KERNELS = f"""kctx as (select distinct y as fold, dayofyear(d) as t from zf),
trd as (select fold, label, dayofyear(d) as doy, sum(n)::double as n from tr group by all),
kn as (select c.fold, c.t, trd.label, sum(n * {KERNEL.format(o="doy", t="c.t")}) as s from kctx c join trd on trd.fold = c.fold group by all),
kraw as (select c.fold, c.t, s.label, coalesce(kn.s, 0) as raw from kctx c join space s on s.fold = c.fold
   left join kn on kn.fold = c.fold and kn.t = c.t and kn.label = s.label),
dk as (select fold, t as day_of_year, label, (raw + 0.5) / sum(raw + 0.5) over (partition by fold, t) as p from kraw)"""
HYBRID = f"""{FEATURES}, {ALL_KEYS}, {affinity_sql('fold', 'tr', 'faff')},
used as (select d, key from feat f where not (key = 'long_weekend' and exists (select 1 from feat g where g.d = f.d and g.key = 'holiday'))),
mult as (select year(u.d) as fold, u.d, s.label, product(coalesce(a.ratio, 1.0)) as m from used u join space s on s.fold = year(u.d)
   left join faff a on a.fold = s.fold and a.label = s.label and a.key = u.key group by all),
hraw as (select m.fold, m.d, m.label, p * least(greatest(m, 0.7), 1.35) as raw from mult m join dk on dk.fold = m.fold
   and dk.day_of_year = dayofyear(m.d) and dk.label = m.label),
dh as (select fold, d, label, (raw + 0.5) / sum(raw + 0.5) over (partition by fold, d) as p from hraw)"""


def evaluate_sql(dist: str, context: list[tuple[str, str]], model: str) -> str:
    """Metrics of one distribution table; ``context``: (column, expression over zf.d)."""
    names = ", ".join(["fold"] + [c for c, _ in context])
    truth = ", ".join(["y as fold"] + [f"{e} as {c}" for c, e in context])
    return f"""{dist}_f as (select *, greatest(p, 1e-9) / sum(greatest(p, 1e-9)) over (partition by {names}) as q from {dist}),
{dist}_r as (select *, row_number() over (partition by {names} order by q desc, label) as rank, max(q) over (partition by {names}) as conf from {dist}_f),
{dist}_t as (select {truth}, label, sum(n)::double as n from zf group by all),
{dist}_h as (select *, least(floor(conf * 10), 9) as bin from {dist}_t join {dist}_r using ({names}, label)),
{dist}_b as (select bin, sum(n) as b_n, sum(case when rank = 1 then n else 0 end) as b_1, sum(n * conf) as b_c from {dist}_h group by bin),
{dist}_m as (select '{model}' as model, sum(n)::bigint as rows, round(sum(case when rank = 1 then n else 0 end) / sum(n), 4) as top1_accuracy,
   round(sum(case when rank <= 3 then n else 0 end) / sum(n), 4) as top3_accuracy, round(sum(-n * ln(q)) / sum(n), 4) as log_loss,
   (select round(sum(abs(b_1 - b_c)) / sum(b_n), 6) from {dist}_b) as calibration_gap from {dist}_h)"""


EVAL_BASE = ", ".join(
    [
        evaluate_sql("dg", [], "global_topk"),
        evaluate_sql("dm", [("month", "month(d)")], "month_frequency"),
        evaluate_sql("dk", [("day_of_year", "dayofyear(d)")], "kernel_seasonal"),
    ]
)
EVAL_HYBRID = evaluate_sql("dh", [("d", "d")], "hybrid_zone")
CLASSES = "(select count(*) from labels) as classes"


@query("dist_normalize", f"with {PF}, n as (select label, sum(n)::double as raw from zf group by label) select label, round((raw + 0.5) / sum(raw + 0.5) over (), 9) as p from n")
def dist_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = place_counts(spark, folder).groupBy("label").agg(F.sum("n").alias("raw")).withColumn("all", F.lit("all"))
    return backtest.normalized(raw, ["all"]).select("label", F.round("p", 9).alias("p"))


@query("dist_global", f"with {ZF}, {FOLDS} select fold::integer as fold, label, round(p, 9) as p from dg")
def dist_global(spark: SparkSession, folder: str) -> DataFrame:
    counts = zone_counts(spark, folder)
    space = cut_lineage(backtest.fold_space(counts))
    return backtest.dist_global(space, backtest.vocabulary(counts)).dense(space).withColumn("p", F.round("p", 9))


@query("dist_month", f"with {ZF}, {FOLDS}, {MONTHS} select fold::integer as fold, month::integer as month, label, round(p, 9) as p from dm")
def dist_month(spark: SparkSession, folder: str) -> DataFrame:
    counts = zone_counts(spark, folder)
    space = cut_lineage(backtest.fold_space(counts))
    return backtest.dist_month(counts, space, backtest.vocabulary(counts)).dense(space).withColumn("p", F.round("p", 9))


@query(
    "dist_kernel",
    f"with {ZF}, {FOLDS}, {KERNELS} select fold::integer as fold, day_of_year::integer as day_of_year, label, round(p, 7) as p from dk",
)
def dist_kernel(spark: SparkSession, folder: str) -> DataFrame:
    counts = zone_counts(spark, folder)
    space = cut_lineage(backtest.fold_space(counts))
    return backtest.dist_kernel(counts, space, backtest.vocabulary(counts)).dense(space).withColumn("p", F.round("p", 7))


@query(
    "dist_hybrid",
    f"with {ZF}, {FOLDS}, {KERNELS}, {HYBRID} select fold::integer as fold, d::varchar as day, label, round(p, 6) as p from dh",
)
def dist_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    counts = zone_counts(spark, folder)
    space = cut_lineage(backtest.fold_space(counts))
    labels = cut_lineage(backtest.vocabulary(counts))
    dist = backtest.dist_hybrid(counts, space, labels, backtest.dist_kernel(counts, space, labels)).dense(space)
    return dist.select("fold", F.col("date").cast("string").alias("day"), "label", F.round("p", 6).alias("p"))


def forest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(seasonal.label_dates(views.finds(spark, folder), "zone", "date_found"))


@query(
    "dist_forest",
    f"""with {views.FINDS}, c as (select zone as label, date_found as d from finds where date_found is not null and zone is not null and zone <> 'Other/Unknown'),
        k as (select count(distinct label) as labels from c)
        select distinct year(d)::integer as fold, dayofyear(d)::integer as day_of_year, month(d)::integer as month, labels::bigint as labels,
          1.0::double as total, true as above_floor from c, k""",
)
def dist_forest(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for every forest: each day of a held-out year has a distribution over all labels, and none of them lies
    below what smoothing alone gives."""
    counts = forest_counts(spark, folder)
    dist = backtest.dist_forest(counts, cut_lineage(backtest.vocabulary(counts)))
    lowest = backtest.ALPHA / (1 + backtest.ALPHA * F.count("*"))
    # without two labels to tell apart the raw values are counts
    learnt = F.max("total") > 1 + backtest.ALPHA * F.count("*") + 1e-6
    dense = dist.dense(backtest.fold_space(counts)).join(dist.contexts.select(*dist.context, "total"), dist.context)
    return dense.groupBy("fold", "day_of_year", "month").agg(
        F.count("*").alias("labels"), F.round(F.sum("p"), 9).alias("total"), ((F.min("p") >= lowest - 1e-12) | learnt).alias("above_floor")
    )


@query("forest_metrics")
def forest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.forest_metrics(forest_counts(spark, folder))


@query(
    "backtest_loyo",
    f"""with {ZF}, {FOLDS}, {MONTHS}, {KERNELS}, {HYBRID}, {EVAL_BASE}, {EVAL_HYBRID}
        select *, {CLASSES} from (select * from dg_m union all select * from dm_m union all select * from dk_m union all select * from dh_m)""",
)
def backtest_loyo(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.backtest(zone_counts(spark, folder))


@query(
    "backtest_exact_place",
    f"""with {PF}, {FOLDS}, {MONTHS}, {KERNELS}, {EVAL_BASE}
        select *, {CLASSES} from (select * from dg_m union all select * from dm_m union all select * from dk_m)""",
)
def backtest_exact_place(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.backtest(place_counts(spark, folder), include_hybrid=False)


@query(
    "calibration_gap",
    f"""with {ZF}, {FOLDS}, {evaluate_sql("dg", [], "global_topk")}
        select bin::bigint as bin, b_n::bigint as rows, round(abs(b_1 - b_c) / b_n, 6) as gap from dg_b""",
)
def calibration_gap(spark: SparkSession, folder: str) -> DataFrame:
    counts = zone_counts(spark, folder)
    space = cut_lineage(backtest.fold_space(counts))
    truth = counts.groupBy(F.col("year").alias("fold"), "label").agg(F.sum("n").alias("n"))
    bins = backtest.scored(backtest.dist_global(space, backtest.vocabulary(counts)), truth, "global_topk")
    return bins.select(
        "bin", "rows", F.round(F.abs(F.col("top1") - F.col("confidence")) / F.col("rows"), 6).alias("gap")
    )


GATE_SQL = """gate as (select max(top3_accuracy) filter (model = 'kernel_seasonal') as k3, max(log_loss) filter (model = 'kernel_seasonal') as kl,
   max(top3_accuracy) filter (model = 'hybrid_zone') as h3, max(log_loss) filter (model = 'hybrid_zone') as hl
   from (select * from dk_m union all select * from dh_m))"""


@query(
    "model_gate",
    f"""with {ZF}, {FOLDS}, {KERNELS}, {HYBRID}, {evaluate_sql("dk", [("day_of_year", "dayofyear(d)")], "kernel_seasonal")},
        {EVAL_HYBRID}, {GATE_SQL}
        select case when k3 > 0 and h3 >= k3 * 1.10 and hl < kl then 'hybrid_zone' else 'kernel_seasonal' end as primary_model,
          case when k3 > 0 and h3 >= k3 * 1.10 and hl < kl then
            printf('Hybrid scorer cleared the gate with top-3 %.4f vs kernel %.4f and lower log loss %.4f vs %.4f.', h3, k3, hl, kl)
          else 'Kernel seasonal baseline remains primary because the richer scorer did not clear the top-3 and log-loss gate.' end as gating_reason,
          'kernel_seasonal,hybrid_zone' as eligible_models from gate""",
)
def model_gate(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.model_gate(backtest.backtest(zone_counts(spark, folder)))


# ---------------------------------------------------------------- briefing

# Readings are of January 2024; the archive ends earlier, so they are moved back by 24 years.
SHIFT_YEARS = 24


def shifted_readings(spark: SparkSession, folder: str) -> DataFrame:
    r = views.readings(spark, folder)
    return r.withColumn("ts", F.col("ts") - F.make_ym_interval(F.lit(SHIFT_YEARS), F.lit(0)))


def lowest_stations(readings: DataFrame) -> DataFrame:
    """Noon probes, one per date: the lowest station that has a reading on it.

    A probe at noon looks back to midnight and ahead past the next one, so every station with a reading on a date has a
    context there, and only the lowest one's is asked for.
    """
    noon = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    lowest = readings.groupBy(F.col("ts").cast("date").alias("date")).agg(F.min("station").alias("station"))
    return lowest.where("date is not null and station is not null").select("station", noon.alias("probe_ts"))


def readings_of_probes(readings: DataFrame, probes: DataFrame) -> DataFrame:
    """Readings of a probe's station on the dates that the probe looks at; others can't be in its context."""
    first = (F.col("probe_ts") - F.make_dt_interval(hours=F.lit(series.HOURS_BEFORE))).cast("date")
    last = (F.col("probe_ts") + F.make_dt_interval(hours=F.lit(series.HOURS_AFTER))).cast("date")
    seen = probes.select("station", F.explode(F.sequence(first, last)).alias("date")).distinct()
    return readings.withColumn("date", F.col("ts").cast("date")).join(seen, ["station", "date"], "left_semi").select(*readings.columns)


def tide_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """Noon context per date: the lowest station that has one (primary first, then fallback).

    The station of a date is chosen first, so only its readings around that date are put in order.
    """
    r = shifted_readings(spark, folder)
    probes = cut_lineage(lowest_stations(r))
    context = series.tide_context(probes, cut_lineage(readings_of_probes(r, probes)))
    return context.select(F.col("probe_ts").cast("date").alias("date"), "stage", "daily_range")


def weather_by_date(spark: SparkSession, folder: str) -> DataFrame:
    r = shifted_readings(spark, folder)
    return r.groupBy(F.col("ts").cast("date").alias("date")).agg(
        F.bround(F.avg("height") / 3, 0).cast("int").alias("wind"),
        F.round(F.count(F.when(F.col("kind") == "click", 1)) / F.count("*") * 200, 0).cast("int").alias("precip_chance"),
        (F.max("height") > 330).alias("severe"),
    )


CONTEXT = f"""readings as (select user_id as station, ts - interval {SHIFT_YEARS} year as ts, value as height, event_type as kind, event_id from events),
{reports.TIDE},
tide_d as (select probe_ts::date as date, arg_min(stage, station) as stage, arg_min(daily_range, station) as daily_range from tide group by 1),
air as (select ts::date as date, round_even(avg(height) / 3, 0)::integer as wind,
   round(count(*) filter (kind = 'click') / count(*) * 200, 0)::integer as precip_chance, max(height) > 330 as severe from readings group by 1)"""

RECENT = """dates as (select distinct d as date from zf),
zrec as (select t.date, f.label as zone, sum(f.n)::bigint as zone_recent from dates t join zf f on f.d between t.date - 30 and t.date group by 1, 2),
arec as (select t.date, count(*) as all_recent from dates t join finds_core f on f.date_found between t.date - 30 and t.date group by 1)"""

MULTIPLIERS = f"""ratios as (select d as date, label as zone, product(coalesce(ratio, 1.0)) as m
   from feat f join aff using (key) where not (key = 'long_weekend' and exists (select 1 from feat g where g.d = f.d and g.key = 'holiday')) group by 1, 2),
flagsd as (select d as date, bool_or(key = 'weekend') as we, bool_or(key = 'holiday') as ho, bool_or(key = 'long_weekend') as lw from feat group by 1),
wide as (select label as zone, max(ratio) filter (key = 'weekend') as r_we, max(ratio) filter (key = 'holiday') as r_ho,
   max(ratio) filter (key = 'long_weekend') as r_lw from aff group by 1),
scored as (
  select r.date, dayofyear(r.date) as day, r.zone, pr.prior, p.dated_support_count, p.years, p.best_months, p.primary_spot, p.tags,
    least(greatest(r.m, 0.85), 1.25) as calendar_mult,
    case when coalesce(zone_recent, 0) > 0 and coalesce(all_recent, 0) > 0 then least(1.0 + least(zone_recent * 0.08, 0.24), 1.25) else 1.0 end::double as recency_mult,
    case when stage is null then 1.0 when contains(p.tags, 'waterfront') then
           1.0 + case when stage = 'rising' then 0.08 else 0 end + case when daily_range >= 2.5 then 0.04 else 0 end
         when contains(p.tags, 'trail') and daily_range >= 2.5 then 0.97 else 1.0 end::double as tide_mult,
    case when severe is null then 1.0 when severe then 0.88 when contains(p.tags, 'waterfront') and wind <= 12 and precip_chance < 50 then 1.05
         when contains(p.tags, 'trail') and wind >= 18 then 1.04 else 1.0 end::double as weather_mult,
    case when ho and r_ho >= 1.08 then 'Holiday timing has helped here before.'
         when not ho and lw and r_lw >= 1.08 then 'Long weekends have historically helped this zone.'
         when we and r_we >= 1.08 then 'Usually stronger on weekends.' end as c_reason,
    coalesce(zone_recent, 0) > 0 and coalesce(all_recent, 0) > 0 as is_recent,
    coalesce(contains(p.tags, 'waterfront') and stage = 'rising', false) as good_tide,
    case when severe then 'severe' when severe is not null and contains(p.tags, 'waterfront') and wind <= 12 and precip_chance < 50 then 'calm' end as w_reason,
    (stage is not null)::integer + (severe is not null)::integer as live_features
  from ratios r join flagsd using (date) join wide using (zone) join priors pr on pr.label = r.zone and pr.day = dayofyear(r.date) and pr.prior > 0
  join profiles p on p.zone = r.zone left join zrec z on z.zone = r.zone and z.date = r.date left join arec a on a.date = r.date
  left join tide_d t on t.date = r.date left join air w on w.date = r.date)"""
BRIEFING = f"{ZF}, {PROFILES}, {PRIORS}, {CONTEXT}, {RECENT}, {MULTIPLIERS}"


def scored(spark: SparkSession, folder: str, counts: DataFrame | None = None, priors: DataFrame | None = None) -> DataFrame:
    counts = zone_counts(spark, folder) if counts is None else counts
    priors = seasonal.seasonal_priors(counts) if priors is None else priors
    dates = counts.select("date").distinct()
    targets = dates.select(F.col("date").alias("target"))
    f = views.finds_core(spark, folder).select("date_found")
    everywhere = recency.recent_activity(f, "date_found", targets).select(
        F.col("target").alias("date"), F.col("last_30").alias("all_recent")
    )
    # zone counts are already per date; a weighted sum over the same 31 days
    near = (
        counts.select(F.col("label").alias("zone"), "n", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("age"), "date")
        .groupBy("zone", F.date_add("date", F.col("age")).alias("date"))
        .agg(F.sum("n").alias("zone_recent"))
    )
    return briefing.scored_zones(
        dates,
        priors,
        profiles(spark, folder, counts),
        near,
        everywhere,
        tide_by_date(spark, folder),
        weather_by_date(spark, folder),
    )


def multiplier_query(column: str):
    def plan(spark: SparkSession, folder: str) -> DataFrame:
        return scored(spark, folder).select(
            F.col("date").cast("string").alias("day"), "zone", F.round(column, 4).alias("multiplier")
        )

    return plan


for _name in ("calendar", "recency", "tide", "weather"):
    query(
        f"{_name}_multiplier",
        f"with {BRIEFING} select date::varchar as day, zone, round({_name}_mult, 4) as multiplier from scored",
    )(multiplier_query(f"{_name}_mult"))


SELECTED = f"""{FOLDS}, {KERNELS}, {HYBRID.removeprefix(f"{FEATURES}, {ALL_KEYS}, ")},
{evaluate_sql("dk", [("day_of_year", "dayofyear(d)")], "kernel_seasonal")}, {EVAL_HYBRID}, {GATE_SQL},
selected as (select case when k3 > 0 and h3 >= k3 * 1.10 and hl < kl then 'hybrid_zone' else 'kernel_seasonal' end as selected_model,
   coalesce(case when k3 > 0 and h3 >= k3 * 1.10 and hl < kl then h3 else k3 end, 0.0) as acc from gate)"""
BRIEF_SQL = f"""{ACTIVITY}, {SELECTED},
final as (select *, prior * case when selected_model = 'hybrid_zone' then calendar_mult * recency_mult * tide_mult * weather_mult else 1.0 end as score
  from scored, selected),
top as (select *, row_number() over (partition by date order by score desc, zone) as rank from final qualify rank <= 3),
strongest as (select day, label as lead_before from (select *, row_number() over (partition by day order by prior desc, label) as k from priors) where k = 1),
lead as (select date, zone as lead_zone, dated_support_count as ds, years as yrs, live_features as lf from top where rank = 1),
brief as (
  select t.date::varchar as date, t.rank::integer as rank, t.zone, round(t.score, 12) as score, t.primary_spot,
    case when t.score / max(t.score) over (partition by t.date) >= 0.85 then 'Best signal'
         when t.score / max(t.score) over (partition by t.date) >= 0.6 then 'Useful fallback' else 'Thin support' end as signal,
    case when len(tg) > 0 then array_to_string(tg[1:3], ',') else 'Strong base seasonal signal' end as reason_tags,
    a.activity as activity_score, case when a.activity >= 7.5 then 'Active' when a.activity >= 4.5 then 'Steady' else 'Quiet' end as activity_label,
    case when acc >= 0.2 and ds >= 18 and yrs >= 3 and lf >= 2 then 'high' when acc >= 0.1 and ds >= 8 and yrs >= 2 then 'medium' else 'low' end as confidence_band,
    t.selected_model,
    case when lead_zone <> lead_before then 'Lead zone rotated from ' || lead_before || ' to ' || lead_zone || '.'
         when round(a.activity - b.activity, 6) >= 0.7 then 'Island-wide activity strengthened from yesterday.'
         when round(a.activity - b.activity, 6) <= -0.7 then 'Island-wide activity softened from yesterday.'
         else 'The daily read is steady versus yesterday.' end as lead_change
  from (select *, list_filter([case when list_contains(string_split(best_months, ',')[1:2], monthname(date)) then 'Strong ' || lower(monthname(date)) || ' history' end,
           case when c_reason is not null then 'Calendar timing fits past hits' end, case when is_recent then 'Recent finds nearby' end,
           case when good_tide then 'Favorable incoming tide' end,
           case w_reason when 'severe' then 'Weather is a drag today' when 'calm' then 'Weather favors shoreline scouting' end], lambda x: x is not null) as tg from top) t
  join lead l on l.date = t.date join activity a on a.day = t.day
  join activity b on b.day = dayofyear(t.date - 1) left join strongest s on s.day = dayofyear(t.date - 1))"""


def brief(spark: SparkSession, folder: str) -> DataFrame:
    """The chain from counts to the briefing: backtest, gate, selected model with its measured accuracy, ranked zones."""
    counts = zone_counts(spark, folder)
    priors, activity = cut_lineage(seasonal.seasonal_priors(counts)), cut_lineage(seasonal.activity_index(counts))
    selected = cut_lineage(backtest.selection(backtest.backtest(counts)))
    return cut_lineage(briefing.daily_briefing(scored(spark, folder, counts, priors), priors, activity, selected))


@query("daily_briefing", f"with {BRIEFING}, {BRIEF_SQL} select * from brief")
def daily_briefing(spark: SparkSession, folder: str) -> DataFrame:
    return brief(spark, folder).select(
        F.col("date").cast("string").alias("date"),
        "rank",
        "zone",
        F.round("score", 12).alias("score"),
        "primary_spot",
        "signal",
        F.concat_ws(",", "reason_tags").alias("reason_tags"),
        "activity_score",
        "activity_label",
        "confidence_band",
        "lead_change",
        "selected_model",
    )


@query(
    "rank_signal",
    f"""with {ZF}, {PRIORS}, r as (select *, prior / max(prior) over (partition by day) as share from priors)
        select day::integer as day, label, case when share >= 0.85 then 'Best signal' when share >= 0.6 then 'Useful fallback' else 'Thin support' end as signal from r""",
)
def rank_signal(spark: SparkSession, folder: str) -> DataFrame:
    priors = seasonal.seasonal_priors(zone_counts(spark, folder))
    best = priors.groupBy("day").agg(F.max("prior").alias("best"))
    return priors.join(best, "day").select(
        "day", "label", briefing.signal_label(F.col("prior"), F.col("best")).alias("signal")
    )


@query(
    "lead_change",
    f"""with {ZF}, {PRIORS}, {ACTIVITY},
        strongest as (select day, label from (select *, row_number() over (partition by day order by prior desc, label) as k from priors) where k = 1),
        dates as (select distinct d as date from zf)
        select date::varchar as date, case when s.label <> b.label then 'Lead zone rotated from ' || b.label || ' to ' || s.label || '.'
         when round(a.activity - p.activity, 6) >= 0.7 then 'Island-wide activity strengthened from yesterday.'
         when round(a.activity - p.activity, 6) <= -0.7 then 'Island-wide activity softened from yesterday.'
         else 'The daily read is steady versus yesterday.' end as lead_change
        from dates join strongest s on s.day = dayofyear(date) left join strongest b on b.day = dayofyear(date - 1)
        join activity a on a.day = dayofyear(date) join activity p on p.day = dayofyear(date - 1)""",
)
def lead_change(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.grouping import top_per_group

    counts = zone_counts(spark, folder)
    priors = seasonal.seasonal_priors(counts)
    strongest = top_per_group(priors, ["day"], [F.col("prior").desc(), F.col("label").asc()], 1)
    dates = counts.select("date").distinct().withColumn("day", F.dayofyear("date"))
    leads = dates.join(strongest, "day").select("date", F.col("label").alias("zone"))
    changes = briefing.lead_changes(priors, seasonal.activity_index(counts), leads)
    return changes.withColumn("date", F.col("date").cast("string"))


@query(
    "confidence_band",
    f"""with {BRIEFING}, {SELECTED} select date::varchar as date, zone,
        case when acc >= 0.2 and dated_support_count >= 18 and years >= 3 and live_features >= 2 then 'high'
             when acc >= 0.1 and dated_support_count >= 8 and years >= 2 then 'medium' else 'low' end as band from scored, selected""",
)
def confidence_band(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of all zones on all dates, from the measured accuracy of the selected model and the live readings of the date."""
    counts = zone_counts(spark, folder)
    selected = cut_lineage(backtest.selection(backtest.backtest(counts)))
    zones_of_dates = scored(spark, folder, counts).select("date", "zone", "dated_support_count", "years", "live_features")
    band = briefing.confidence_band(F.col("top3_accuracy"), F.col("dated_support_count"), F.col("years"), F.col("live_features"))
    return zones_of_dates.join(F.broadcast(selected)).select(F.col("date").cast("string").alias("date"), "zone", band.alias("band"))


# ---------------------------------------------------------------- shortlists


LAST_DAY = "last as (select max(date) as date from brief)"
SHORTLIST_ZONES = f"""{LAST_DAY}, top_zones as (select zone, rank as zone_rank from brief join last using (date)),
zm as (select name, zone_rank, member_rank from members join top_zones using (zone) where member_rank <= 5)"""


def shortlist_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Members of zones, and the ranked zones of the newest briefing: zone, zone_rank."""
    ranked = brief(spark, folder).select("date", "zone", "rank")
    newest = ranked.agg(F.max("date").alias("newest"))
    top = ranked.join(F.broadcast(newest), F.col("date") == F.col("newest")).select("zone", F.col("rank").alias("zone_rank"))
    return cut_lineage(reports.members(spark, folder)), top


@query(
    "tiered_shortlist",
    f"""with {BRIEFING}, {BRIEF_SQL}, {SHORTLIST_ZONES}, {reports.MAPPED_PART},
        spot_zone as (select name, min(zone_rank * 10 + member_rank) as slot from zm group by name),
        l as (select m.name, m.reports, z.slot from mapped m left join spot_zone z on z.name = m.name),
        best as (select name from l order by case when slot = 11 then 0 else 1 end, reports desc, name limit 1),
        o as (select l.*, row_number() over (order by slot nulls last, reports desc, name) as p,
                 count(slot) over () as zs from l where name not in (select name from best))
        select name, reports, '1 best bet' as tier, 1 as position from l where name in (select name from best)
        union all select name, reports, '2 worthwhile', cast(p + 1 as integer) from o where p <= 4
        union all select name, reports, '3 more options', cast(p + 1 as integer) from o where slot is null and p - greatest(zs, 4) between 1 and 6""",
)
def tiered_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    members, top = shortlist_inputs(spark, folder)
    return archive.shortlist(reports.mapped(spark, folder).select("name", "reports"), cut_lineage(top), zones.top_members(members))


@query(
    "spot_rank_lookup",
    f"with {BRIEFING}, {BRIEF_SQL}, {SHORTLIST_ZONES} select name, max(zone_rank) as zone_rank from zm group by name",
)
def spot_rank_lookup(spark: SparkSession, folder: str) -> DataFrame:
    members, top = shortlist_inputs(spark, folder)
    return zones.top_members(members).join(top, "zone").groupBy("name").agg(F.max("zone_rank").alias("zone_rank"))


@query(
    "artifact_freshness",
    """with e as (select event_id, greatest(date_diff('microsecond', ts, timestamp '2024-01-25 12:00:00') // 1000000, 0) as s from events)
       select event_id, s >= 172800 as is_stale, case when s < 86400 then greatest(s // 3600, 1) || ' hour' || case when greatest(s // 3600, 1) = 1 then '' else 's' end
         when s // 86400 < 7 then (s // 86400) || ' day' || case when s // 86400 = 1 then '' else 's' end
         else (s // 604800) || ' week' || case when s // 604800 = 1 then '' else 's' end end as age from e""",
)
def artifact_freshness(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return table(spark, folder, "events").select("event_id", *briefing.freshness(F.col("ts"), now))
