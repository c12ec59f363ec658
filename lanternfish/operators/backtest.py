"""Leave-one-year-out comparison of label distributions.

A fold holds out one year. Training figures are "all years minus the held-out one", so nothing
is recomputed per fold, and a distribution is worked out once per fold and context (month, day,
date), never per report. Distributions are sparse: labels without a row share one score, whose part
of the total is known in closed form, so labels are never spread out over contexts to be summed,
ranked or floored, and no window holds all labels of a context.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import forest, seasonal

# Additive smoothing, probability floor, bins, hybrid clamp, forest size and seed.
ALPHA = 0.5
FLOOR = 1e-9
BINS = 10
CLAMP = (0.7, 1.35)
TREES = 100
SEED = 42

# Ranks that the metrics ask for.
TOP = 3

# Texts of the gate.
GATE_CLEARED = "Hybrid scorer cleared the gate with top-3 %.4f vs kernel %.4f and lower log loss %.4f vs %.4f."
GATE_KEPT = "Kernel seasonal baseline remains primary because the richer scorer did not clear the top-3 and log-loss gate."

# The richer model must reach this multiple of the kernel's top-3 accuracy.
GATE = 1.10


def fold_space(counts: DataFrame) -> DataFrame:
    """(fold, label, rows): every label in every fold with its training rows."""
    labels = counts.groupBy("label").agg(F.sum("n").alias("all_rows"))
    # one row with the few distinct years, so pairing labels with folds needs no cross join
    years = counts.agg(F.sort_array(F.collect_set("year")).alias("folds"))
    spine = labels.join(F.broadcast(years)).select("label", "all_rows", F.explode("folds").alias("fold"))
    held = counts.groupBy(F.col("year").alias("fold"), "label").agg(F.sum("n").alias("held"))
    return spine.join(held, ["fold", "label"], "left").select(
        "fold", "label", (F.col("all_rows") - F.coalesce("held", F.lit(0))).alias("rows")
    )


def normalized(raw: DataFrame, context: list[str]) -> DataFrame:
    """raw + alpha, scaled to 1 per context; raw has a row for every label."""
    totals = raw.groupBy(*context).agg(F.sum(F.col("raw") + ALPHA).alias("total"))
    return raw.join(totals, context).select(*context, "label", ((F.col("raw") + ALPHA) / F.col("total")).alias("p"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """One row: the number of labels, and the first of them, which come before other labels of equal score."""
    labels = counts.select("label").distinct()
    first = labels.orderBy("label").limit(TOP).agg(F.sort_array(F.collect_list("label")).alias("first_labels"))
    return labels.agg(F.count("*").alias("n_labels")).join(F.broadcast(first))


@dataclass(frozen=True)
class Distribution:
    """``raw``: (context, label, raw); ``contexts``: (context, base, total, first_labels). A label without a row scores
    ``base``; total is the sum of score + alpha over all labels."""

    context: list[str]
    raw: DataFrame
    contexts: DataFrame

    @classmethod
    def of(cls, raw: DataFrame, contexts: DataFrame, labels: DataFrame, context: list[str]) -> Distribution:
        """``contexts``: context and maybe base, ``labels``: the vocabulary."""
        if "base" not in contexts.columns:
            contexts = contexts.withColumn("base", F.lit(0.0))
        sums = raw.groupBy(*context).agg(F.sum("raw").alias("known"), F.count("*").alias("n_known"))
        known, n_known = F.coalesce("known", F.lit(0.0)), F.coalesce("n_known", F.lit(0))
        total = known + (F.col("n_labels") - n_known) * F.col("base") + ALPHA * F.col("n_labels")
        joined = contexts.join(sums, context, "left").join(F.broadcast(labels))
        return cls(context, raw, cut_lineage(joined.select(*context, "base", total.alias("total"), n_known.alias("n_known"), "n_labels", "first_labels")))

    def known(self) -> DataFrame:
        """(context, label, p) of the labels that have a row; there are few contexts, bounded by the calendar."""
        return self.raw.join(self.contexts, self.context).select(
            *self.context, "label", ((F.col("raw") + ALPHA) / F.col("total")).alias("p")
        )

    def dense(self, space: DataFrame) -> DataFrame:
        """(context, label, p) of all labels of a fold; space: (fold, label)."""
        spread = self.contexts.join(space.select("fold", "label"), "fold").join(self.raw, [*self.context, "label"], "left")
        p = (F.coalesce("raw", "base") + ALPHA) / F.col("total")
        return spread.select(*self.context, "label", p.alias("p"))

    def floored(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Floored and renormalised probabilities: (context, label, q) of labels with a row, (context, rest_q, confidence)
        with the value of all others, and (context, label, rank) of the best labels."""
        p = self.known().withColumn("q", F.greatest("p", F.lit(FLOOR)))
        sums = p.groupBy(*self.context).agg(F.sum("q").alias("known_q"))
        rest = F.greatest((F.col("base") + ALPHA) / F.col("total"), F.lit(FLOOR))
        scale = F.coalesce("known_q", F.lit(0.0)) + (F.col("n_labels") - F.col("n_known")) * rest
        scales = self.contexts.join(sums, self.context, "left").select(*self.context, (rest / scale).alias("rest_q"), scale.alias("scale"), "first_labels")
        scales = cut_lineage(scales)
        q = p.join(scales, self.context).select(*self.context, "label", (F.col("q") / F.col("scale")).alias("q"), "rest_q")
        # labels at the common value are ranked by name; of those, the first few can matter
        others = scales.select(*self.context, F.explode("first_labels").alias("label"), F.col("rest_q").alias("q"))
        best = q.where(F.col("q") > F.col("rest_q")).select(*self.context, "label", "q").unionByName(others)
        order = [F.col("q").desc(), F.col("label").asc()]
        # a label may be there twice, so twice as many are looked at
        cut = best.withColumn("k", F.row_number().over(W.partitionBy(*self.context).orderBy(*order))).where(F.col("k") <= 2 * TOP)
        once = cut.groupBy(*self.context, "label").agg(F.max("q").alias("q"))
        rank = F.row_number().over(W.partitionBy(*self.context).orderBy(*order))
        top = cut_lineage(once.withColumn("rank", rank).where(F.col("rank") <= TOP))
        confidence = top.where("rank = 1").select(*self.context, F.col("q").alias("confidence"))
        return q.drop("rest_q"), scales.join(confidence, self.context).select(*self.context, "rest_q", "confidence"), top.drop("q")


def dist_global(space: DataFrame, labels: DataFrame) -> Distribution:
    raw = space.where("rows > 0").select("fold", "label", F.col("rows").cast("double").alias("raw"))
    return Distribution.of(raw, space.select("fold").distinct(), labels, ["fold"])


def dist_month(counts: DataFrame, space: DataFrame, labels: DataFrame) -> Distribution:
    """Label frequencies of the month; the global ones when the month has no training rows."""
    monthly = counts.groupBy("year", F.month("date").alias("month"), "label").agg(F.sum("n").alias("n"))
    overall = monthly.groupBy("month", "label").agg(F.sum("n").alias("all_n"))
    held = monthly.select(F.col("year").alias("fold"), "month", "label", F.col("n").alias("held_n"))
    contexts = held.select("fold", "month").distinct()
    raw = contexts.join(overall, "month").join(held, ["fold", "month", "label"], "left")
    raw = raw.select("fold", "month", "label", (F.col("all_n") - F.coalesce("held_n", F.lit(0))).cast("double").alias("raw")).where("raw > 0")
    raw = cut_lineage(raw)
    bare = contexts.join(raw.select("fold", "month").distinct(), ["fold", "month"], "left_anti")
    instead = bare.join(space.where("rows > 0"), "fold").select("fold", "month", "label", F.col("rows").cast("double").alias("raw"))
    return Distribution.of(raw.unionByName(instead), contexts, labels, ["fold", "month"])


def dist_kernel(counts: DataFrame, space: DataFrame, labels: DataFrame) -> Distribution:
    """Kernel scores of the training years at every held-out day; only labels with training rows have a score."""
    daily = counts.withColumn("day_of_year", F.dayofyear("date"))
    scores = seasonal.kernel_scores(daily, ["year", "label"]).withColumnRenamed("target_day", "day_of_year")
    scores = cut_lineage(scores)
    overall = scores.groupBy("label", "day_of_year").agg(F.sum("score").alias("all_score"))
    held = scores.select(F.col("year").alias("fold"), "label", "day_of_year", F.col("score").alias("held_score"))
    contexts = daily.select(F.col("year").alias("fold"), "day_of_year").distinct()
    raw = (
        contexts.join(overall, "day_of_year")
        .join(space.where("rows > 0").select("fold", "label"), ["fold", "label"], "left_semi")
        .join(held, ["fold", "label", "day_of_year"], "left")
        .select("fold", "day_of_year", "label", F.greatest(F.col("all_score") - F.coalesce("held_score", F.lit(0.0)), F.lit(0.0)).alias("raw"))
    )
    return Distribution.of(cut_lineage(raw), contexts, labels, ["fold", "day_of_year"])


def multiplier(ratios: Column, keys: Column) -> Column:
    """Product of the ratios of a date's keys; on a holiday the long weekend does not count again."""
    used = F.filter(keys, lambda k: ~((k == "long_weekend") & F.array_contains(keys, "holiday")))
    factors = F.transform(used, lambda k: F.coalesce(F.try_element_at(ratios, k), F.lit(1.0)))
    return F.aggregate(factors, F.lit(1.0), lambda acc, x: acc * x)


def dist_hybrid(counts: DataFrame, space: DataFrame, labels: DataFrame, kernel: Distribution) -> Distribution:
    """Kernel distribution times the clamped calendar affinity of the training years, per date. A label without training
    rows has no affinity: it keeps the kernel's common value."""
    known = space.where("rows > 0")
    ratios = seasonal.ratio_map(seasonal.fold_affinity(counts, known), ["fold", "label"])
    dates = cut_lineage(seasonal.date_features(counts).select("date", F.year("date").alias("fold"), F.dayofyear("date").alias("day_of_year"), "keys"))
    joined = dates.join(kernel.known(), ["fold", "day_of_year"]).join(ratios, ["fold", "label"], "left")
    factor = F.least(F.greatest(multiplier(F.col("ratios"), F.col("keys")), F.lit(CLAMP[0])), F.lit(CLAMP[1]))
    raw = joined.select("fold", "date", "label", (F.col("p") * factor).alias("raw"))
    base = ((F.col("base") + ALPHA) / F.col("total")).alias("base")
    contexts = dates.join(kernel.contexts, ["fold", "day_of_year"]).select("fold", "date", base)
    return Distribution.of(cut_lineage(raw), contexts, labels, ["fold", "date"])


def dist_forest(counts: DataFrame, labels: DataFrame, trees: int = TREES) -> Distribution:
    """Mean leaf shares of a random forest on the yearly cycle and the month."""
    raw = cut_lineage(forest.forest(counts, trees, SEED))
    contexts = counts.select(F.col("year").alias("fold"), F.dayofyear("date").alias("day_of_year"), F.month("date").alias("month")).distinct()
    return Distribution.of(raw, contexts, labels, ["fold", "day_of_year", "month"])


def scored(dist: Distribution, truth: DataFrame, model: str) -> DataFrame:
    """Held-out counts joined with their probability, summed per confidence bin."""
    q, contexts, top = dist.floored()
    keys = [*dist.context, "label"]
    hits = truth.join(contexts, dist.context).join(q, keys, "left").join(top, keys, "left")
    bin_of = F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1))
    n = F.col("n")
    return hits.groupBy(F.lit(model).alias("model"), bin_of.alias("bin")).agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("rank") == 1, n).otherwise(0)).alias("top1"),
        F.sum(F.when(F.col("rank") <= 3, n).otherwise(0)).alias("top3"),
        F.sum(-n * F.log(F.coalesce("q", "rest_q"))).alias("loss"),
        F.sum(n * F.col("confidence")).alias("confidence"),
    )


def metrics(bins: DataFrame, classes: DataFrame) -> DataFrame:
    """Per model: rows, classes, top-1, top-3, log loss, calibration gap."""
    rows = F.sum("rows")
    # sum over bins of |accuracy - confidence| * share = sum |top1 - confidence| / rows
    gap = F.sum(F.abs(F.col("top1") - F.col("confidence")))
    return (
        bins.groupBy("model")
        .agg(
            rows.alias("rows"),
            F.round(F.sum("top1") / rows, 4).alias("top1_accuracy"),
            F.round(F.sum("top3") / rows, 4).alias("top3_accuracy"),
            F.round(F.sum("loss") / rows, 4).alias("log_loss"),
            F.round(gap / rows, 6).alias("calibration_gap"),
        )
        .join(F.broadcast(classes))
    )


def enough(counts: DataFrame) -> DataFrame:
    """The number of classes, one row; none below 10 rows, 2 years or 2 labels."""
    return (
        counts.agg(F.count_distinct("label").alias("classes"), F.count_distinct("year").alias("_years"), F.sum("n").alias("_rows"))
        .where((F.col("_rows") >= seasonal.MIN_TRAINING_ROWS) & (F.col("_years") >= 2) & (F.col("classes") >= 2))
        .select("classes")
    )


def backtest(counts: DataFrame, include_hybrid: bool = True) -> DataFrame:
    """Metrics of all distribution models; empty below 10 rows, 2 years or 2 labels.

    ``counts``: label, date, year, n - best written out with ``cut_lineage``, it is read often.
    """
    # compact results that every model needs more than once; ``counts`` should be a table already
    space, labels = cut_lineage(fold_space(counts)), cut_lineage(vocabulary(counts))
    kernel = dist_kernel(counts, space, labels)
    fold = F.col("year").alias("fold")

    def truth(*context: Column) -> DataFrame:
        return counts.groupBy(fold, *context, "label").agg(F.sum("n").alias("n"))

    parts = [
        scored(dist_global(space, labels), truth(), "global_topk"),
        scored(dist_month(counts, space, labels), truth(F.month("date").alias("month")), "month_frequency"),
        scored(kernel, truth(F.dayofyear("date").alias("day_of_year")), "kernel_seasonal"),
    ]
    if include_hybrid:
        parts.append(scored(dist_hybrid(counts, space, labels, kernel), truth(F.col("date")), "hybrid_zone"))
    bins = reduce(lambda a, b: a.unionByName(b), parts)
    return metrics(bins, enough(counts))


def model_gate(measured: DataFrame) -> DataFrame:
    """Hybrid wins only with 10 % more top-3 accuracy than the kernel and a lower log loss."""

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    one = measured.agg(
        of("kernel_seasonal", "top3_accuracy").alias("k3"),
        of("kernel_seasonal", "log_loss").alias("kl"),
        of("hybrid_zone", "top3_accuracy").alias("h3"),
        of("hybrid_zone", "log_loss").alias("hl"),
    )
    wins = (F.col("k3") > 0) & (F.col("h3") >= F.col("k3") * GATE) & (F.col("hl") < F.col("kl"))
    wins = F.coalesce(wins, F.lit(False))
    cleared = F.format_string(GATE_CLEARED, "h3", "k3", "hl", "kl")
    reason = (
        F.when(F.col("k3").isNull(), F.lit("Cluster evaluation data is unavailable."))
        .when(wins, cleared)
        .otherwise(F.lit(GATE_KEPT))
    )
    eligible = (
        F.when(F.col("k3").isNull(), F.lit(""))
        .when(F.col("h3").isNull(), F.lit("kernel_seasonal"))
        .otherwise(F.lit("kernel_seasonal,hybrid_zone"))
    )
    return one.select(
        F.when(wins, "hybrid_zone").otherwise("kernel_seasonal").alias("primary_model"),
        reason.alias("gating_reason"),
        eligible.alias("eligible_models"),
    )


def selection(measured: DataFrame) -> DataFrame:
    """One row: the model that the gate selects and its top-3 accuracy, the kernel's where the model wasn't measured, 0
    where nothing was."""
    gate = model_gate(measured).select("primary_model")
    of = measured.select("model", F.col("top3_accuracy").cast("double").alias("top3_accuracy"))
    pick = lambda name: F.max(F.when(F.col("model") == name, F.col("top3_accuracy")))
    found = of.join(F.broadcast(gate), how="right").groupBy("primary_model")
    return found.agg(F.coalesce(pick(F.col("primary_model")), pick("kernel_seasonal"), F.lit(0.0)).alias("top3_accuracy"))


def forest_metrics(counts: DataFrame, trees: int = TREES) -> DataFrame:
    """Metrics of the forest; empty below 10 rows, 2 years or 2 labels, as in ``backtest``."""
    days = F.dayofyear("date").alias("day_of_year"), F.month("date").alias("month")
    truth = counts.groupBy(F.col("year").alias("fold"), *days, "label").agg(F.sum("n").alias("n"))
    bins = scored(dist_forest(counts, cut_lineage(vocabulary(counts)), trees), truth, "current_random_forest")
    return metrics(bins, enough(counts))
