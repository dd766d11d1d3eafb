"""Split-conformal calibration and reliability of fire probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.channels import at_least
from .metrics import f1_score, jaccard, ratio_or

_SLOTS = 256
_CELLS = 4096
# Relative rank error of the sketch, and how many such errors a bracket reaches to either side of the rank.
_ACCURACY = 10_000
_MARGIN = 4
_BELOW = -(2**50)


def nonconformity(prob: Column, positive: Column) -> Column:
    """1 − p for positives, p for negatives."""
    return F.when(positive, 1.0 - prob).otherwise(prob)


def _score_bucket(score: Column) -> Column:
    """Monotone integral bucket, fine near 0 and near 1 where probabilities crowd; NaN comes last, NULL first."""
    low = F.floor(F.log2(F.greatest(score, F.lit(5e-324))) * _SLOTS)
    high = -F.floor(F.log2(F.greatest(1.0 - score, F.lit(5e-324))) * _SLOTS)
    bucket = F.when(F.isnan(score), F.lit(2**40)).when(score < 0.5, low).otherwise(high)
    return F.when(score.isNull(), F.lit(-(2**40))).otherwise(bucket).cast("long")


def _slice(score: Column) -> Column:
    """Which of ``_CELLS`` equal parts of ``__lo`` to ``__hi`` a score lies in; a bucket where that range has no finite width."""
    width = F.col("__hi") - F.col("__lo")
    part = F.floor((score - F.col("__lo")) / F.nullif(width, F.lit(0.0)) * _CELLS)
    cell = F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(_CELLS - 1)), F.lit(0)).cast("long")
    return F.when(F.abs(width) < float("inf"), cell).otherwise(_score_bucket(score))


def conformal_quantile(scores: DataFrame, alpha: float, *, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Exact order statistic at the finite-sample level, per group: qhat and n.

    With m = ceil((n + 1)(1 − α)), this is the score at 0-based rank
    min(m, n − 1) of the sorted scores; NULL scores come first, NaN last. Two passes: a mergeable quantile sketch
    gives two scores between which the rank must lie (its rank error is bounded, and the bracket
    is four times as wide), then the scores below are counted and those in between are ranked. No row is shuffled, only
    counts: of the bracket's distinct scores, whose slices are summed before any are put in order. An empty input gives no row.
    """
    _check_alpha(alpha)
    return _rank(scores.select(*by, F.col(score).cast("double").alias("__score")), list(by), alpha)


def _check_alpha(alpha: float) -> None:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha lies outside the open interval from 0 to 1: {alpha}")


def _rank(rows: DataFrame, keys: list[str], alpha: float, few_groups: bool = False) -> DataFrame:
    """Quantile per group of ``__score``: keys, qhat, n. ``few_groups``: a known handful, fit to be broadcast."""
    value = F.col("__score")
    placed = F.when(value.isNull(), F.lit(float("-inf"))).when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
    reach = _MARGIN / _ACCURACY
    levels = [max(0.0, 1.0 - alpha - reach), min(1.0, 1.0 - alpha + reach)]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(placed, levels, _ACCURACY).alias("__e"))
    # Up to the sketch's accuracy a group is small enough to be ranked whole, and rounding of the rank outweighs the margin.
    small = F.col("n") <= _ACCURACY
    groups = groups.where("n > 0").select(
        *keys, "n", F.least(F.ceil((F.col("n") + 1) * (1.0 - alpha)), F.col("n") - 1).alias("__left"),
        F.when(small, F.lit(float("-inf"))).otherwise(F.col("__e")[0]).alias("__lo"),
        F.when(small, F.lit(float("inf"))).otherwise(F.col("__e")[1]).alias("__hi"))
    known = F.broadcast(groups) if few_groups or not keys else groups
    joined = rows.join(known, keys) if keys else rows.join(known, F.lit(True))
    below = placed < F.col("__lo")
    group = [*keys, "n", "__left"]
    part = F.when(below, F.lit(_BELOW)).otherwise(_slice(value)).alias("__b")
    counts = joined.where(placed <= F.col("__hi")).groupBy(*group, part, F.when(~below, value).alias("__score")).agg(F.count(F.lit(1)).alias("__n"))
    slices = counts.groupBy(*group, "__b").agg(F.sum("__n").alias("__n"))
    held = _holding(slices, keys, "__b").drop("__n", "n")
    last = counts.drop("__left").join(F.broadcast(held) if few_groups or not keys else held, [*keys, "__b"])
    return _holding(last, keys, "__score").select(*keys, value.alias("qhat"), "n")


def _holding(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each group whose count spans rank ``__left``, which then counts from that row's first."""
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumn("__before", upto - F.col("__n")).where(F.col("__left").between(
        F.col("__before"), F.col("__before") + F.col("__n") - 1))
    return spans.withColumn("__left", F.col("__left") - F.col("__before")).drop("__before")


def class_quantiles(calibration: DataFrame, alpha: float, prob: str = "prob", label: str = "label") -> DataFrame:
    """q0 and q1 by class, both the global quantile when a class is absent; one row (none for empty input)."""
    _check_alpha(alpha)
    positive = F.col(label) > 0
    # Both classes and the whole set are ranked in one scan: group 2 holds every score.
    rows = calibration.select(
        F.explode(F.array(positive.cast("int"), F.lit(2))).alias("__group"), nonconformity(F.col(prob), positive).cast("double").alias("__score"))
    q = _rank(rows, ["__group"], alpha, few_groups=True)

    def of(group: int, c: str) -> Column:
        return F.max(F.when(F.col("__group") == group, F.col(c)))

    n_neg, n_pos = F.coalesce(of(0, "n"), F.lit(0)), F.coalesce(of(1, "n"), F.lit(0))
    absent = (n_neg == 0) | (n_pos == 0)
    return q.agg(
        F.when(absent, of(2, "qhat")).otherwise(of(0, "qhat")).alias("q0"),
        F.when(absent, of(2, "qhat")).otherwise(of(1, "qhat")).alias("q1"),
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
    ).where(F.col("q0").isNotNull())


def prediction_sets(predictions: DataFrame, quantiles: DataFrame, prob: str = "prob") -> DataFrame:
    """include_no_fire, include_fire and uncertain of every pixel.

    ``quantiles`` is the one-row result of ``class_quantiles``; a single row is
    its size bound, so it is broadcast.
    """
    q = F.broadcast(quantiles.agg(F.max("q0").alias("q0"), F.max("q1").alias("q1")))
    # Without calibration scores of a class there is no quantile, and no set can be formed.
    missing = F.raise_error(F.lit("empty calibration set: no quantile")).cast("double")
    joined = predictions.join(q.select(*[F.coalesce(c, missing).alias(c) for c in ("q0", "q1")]), F.lit(True))
    fire = (1.0 - F.col(prob)) <= F.col("q1")
    none = F.col(prob) <= F.col("q0")
    return joined.withColumns(
        {"include_no_fire": none, "include_fire": fire, "uncertain": none & fire}
    ).drop("q0", "q1")


def _reliability_sums(label: Column, prob: Column, threshold: float) -> dict[str, Column]:
    fire, none = F.col("include_fire"), F.col("include_no_fire")
    base = at_least(prob, threshold)
    sure, sure_fire = fire != none, fire & ~none
    wrong = base != label
    return {
        "num_pixels": F.count(F.lit(1)),
        "covered": F.count_if(F.when(label, fire).otherwise(none)),
        "num_uncertain_pixels": F.count_if(fire & none),
        "num_confident_pixels": F.count_if(sure),
        "num_errors_baseline": F.count_if(wrong),
        "captured": F.count_if(wrong & fire & none),
        "b_tp": F.count_if(label & base), "b_fp": F.count_if(~label & base), "b_fn": F.count_if(label & ~base),
        "s_tp": F.count_if(sure & label & sure_fire), "s_fp": F.count_if(sure & ~label & sure_fire),
        "s_fn": F.count_if(sure & label & ~sure_fire),
    }


_RATIOS = ("coverage", "uncertainty_rate", "error_capture_rate", "baseline_f1", "baseline_iou",
           "selective_f1", "selective_iou")
_COUNTS = ("num_pixels", "num_confident_pixels", "num_uncertain_pixels", "num_errors_baseline")


def _with_ratios(sums: DataFrame) -> DataFrame:
    c = F.col
    some = c("num_confident_pixels") > 0
    nan = F.lit(float("nan"))
    return sums.withColumns(
        {
            "coverage": c("covered") / c("num_pixels"),
            "uncertainty_rate": c("num_uncertain_pixels") / c("num_pixels"),
            "error_capture_rate": ratio_or(c("captured"), c("num_errors_baseline"), 0.0),
            "baseline_f1": f1_score(c("b_tp"), c("b_fp"), c("b_fn"), 1.0),
            "baseline_iou": jaccard(c("b_tp"), c("b_fp"), c("b_fn"), 1.0),
            "selective_f1": F.when(some, f1_score(c("s_tp"), c("s_fp"), c("s_fn"), 1.0)).otherwise(nan),
            "selective_iou": F.when(some, jaccard(c("s_tp"), c("s_fp"), c("s_fn"), 1.0)).otherwise(nan),
        }
    )


def reliability(predictions: DataFrame, quantiles: DataFrame, *, threshold: float = 0.5,
                prob: str = "prob", label: str = "label", case: str = "case_id") -> DataFrame:
    """Reliability of every case and of all pixels together (case NULL, scope 'global').

    Case sums come from one pass over the pixels; the global row adds the case
    sums up, so pixels are aggregated once.
    """
    sets = prediction_sets(predictions, quantiles, prob)
    sums = _reliability_sums(F.col(label) > 0, F.col(prob), threshold)
    per_case = sets.groupBy(case).agg(*[v.alias(n) for n, v in sums.items()])
    both = per_case.groupingSets([[F.col(case)], []], case).agg(
        F.grouping(case).alias("__all"), *[F.sum(n).alias(n) for n in sums]
    )
    scope = F.when(F.col("__all") == 1, "global").otherwise("case")
    # An empty input still yields the grand-total row; it has no pixels to speak of.
    return _with_ratios(both.where(F.col("num_pixels") > 0)).select(scope.alias("scope"), case, *_RATIOS, *_COUNTS)


def macro_reliability(report: DataFrame) -> DataFrame:
    """Mean of each ratio over cases, cases without a value left out."""
    def real(c: str) -> Column:
        return F.nanvl(F.col(c), F.lit(None).cast("double"))

    return report.where(F.col("scope") == "case").agg(
        *[F.avg(real(c)).alias(c) for c in _RATIOS], F.count(F.lit(1)).alias("num_test_cases")
    )
