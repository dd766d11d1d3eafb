"""Segmentation scores from conditional sums: nothing is sorted or gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.channels import sigmoid

ZERO_DIVISION = {"pred": 0.0, "af": 1.0, "ba": 1.0}


def confusion_counts(label: Column, pred: Column) -> dict[str, Column]:
    """tp, fp, fn, tn of boolean columns, with label and prediction totals."""
    return {
        "tp": F.count_if(label & pred),
        "fp": F.count_if(~label & pred),
        "fn": F.count_if(label & ~pred),
        "tn": F.count_if(~label & ~pred),
    }


def ratio_or(num: Column, den: Column, otherwise: float | None) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise).cast("double"))


def f1_score(tp: Column, fp: Column, fn: Column, zero_division: float) -> Column:
    return ratio_or(2 * tp, 2 * tp + fp + fn, zero_division)


def jaccard(tp: Column, fp: Column, fn: Column, zero_division: float) -> Column:
    return ratio_or(tp, tp + fp + fn, zero_division)


def frame_scores(
    pixels: DataFrame, keys: Sequence[str], label: Column, pred: Column, *, zero_division: float,
) -> DataFrame:
    """Counts, F1 and IoU of every frame (or of whatever ``keys`` name: a window, a case)."""
    counts = pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in confusion_counts(label, pred).items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "f1": f1_score(tp, fp, fn, zero_division),
            "iou": jaccard(tp, fp, fn, zero_division),
            "pred_positive": tp + fp,
            "label_positive": tp + fn,
        }
    )


def fire_scores(frames: DataFrame, fire: str = "case_id") -> DataFrame:
    """Per fire: mean scores over frames, totals and frames without any prediction."""
    return frames.groupBy(fire).agg(
        F.avg("f1").alias("f1"),
        F.avg("iou").alias("iou"),
        F.sum("pred_positive").alias("pred_positive"),
        F.sum("label_positive").alias("label_positive"),
        F.count_if(F.col("pred_positive") == 0).alias("zero_prediction_frames"),
        F.count(F.lit(1)).alias("frames"),
    )


def macro_scores(fires: DataFrame, *, drop_empty: bool, listed: int | Column | None = None) -> DataFrame:
    """Mean over fires, one row.

    drop_empty  leave out fires without a positive label and divide by the fires
                evaluated (next-day growth)
    listed      divide by this number of listed fires instead, counting fires
                that were never scored as zero (active fire, burned area)
    """
    counted = (F.col("label_positive") > 0) if drop_empty else F.lit(True)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0))

    evaluated = F.count_if(counted)
    divisor = evaluated if listed is None else (F.lit(listed) if isinstance(listed, int) else listed)
    return fires.agg(
        ratio_or(total("f1"), divisor, None).alias("f1"),
        ratio_or(total("iou"), divisor, None).alias("iou"),
        evaluated.alias("evaluated_fires"),
        F.count_if(~counted).alias("skipped_fires"),
        total("pred_positive").alias("pred_positive"),
        total("label_positive").alias("label_positive"),
        total("zero_prediction_frames").alias("zero_prediction_frames"),
        total("frames").alias("frames"),
    )


def class_scores(pixels: DataFrame, keys: Sequence[str], label: Column, pred: Column, *,
                 empty: float | None = 1.0) -> DataFrame:
    """IoU and Dice of background and fire, and their mean over both classes.

    ``empty`` is the score of a class absent from label and prediction: 1 by
    default; with None it is NULL and left out of the mean.
    """
    counts = pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in confusion_counts(label, pred).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scored = counts.withColumns(
        {
            "iou_fire": ratio_or(tp, tp + fp + fn, empty),
            "iou_background": ratio_or(tn, tn + fp + fn, empty),
            "dice_fire": ratio_or(2 * tp, 2 * tp + fp + fn, empty),
            "dice_background": ratio_or(2 * tn, 2 * tn + fp + fn, empty),
        }
    )
    return scored.withColumns(
        {"mean_iou": _mean("iou_fire", "iou_background"), "mean_dice": _mean("dice_fire", "dice_background")}
    )


def _mean(*cols: str) -> Column:
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def categorical_accuracy(pixels: DataFrame, keys: Sequence[str], scores: Sequence[Column], label: Column) -> DataFrame:
    """Share of pixels whose best-scoring class (first wins ties) is the label."""
    best = F.array_position(F.array(*scores), F.greatest(*scores)) - 1
    return pixels.groupBy(*keys).agg(F.avg((best == label).cast("int")).alias("accuracy"))


def _dice_loss(logit: Column, target: Column, smooth: float) -> Column:
    p, y = sigmoid(logit), target.cast("double")
    return (1.0 - (2 * F.sum(p * y) + smooth) / (F.sum(p) + F.sum(y) + smooth)).alias("dice_loss")


def _focal_loss(logit: Column, target: Column, gamma: float, alpha: float) -> Column:
    p, y = sigmoid(logit), target.cast("double")
    cross = F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0)) - logit * y
    hit = p * y + (1 - p) * (1 - y)
    weight = alpha * y + (1 - alpha) * (1 - y)
    return F.avg(weight * F.pow(1 - hit, F.lit(gamma)) * cross).alias("focal_loss")


def soft_dice_loss(pixels: DataFrame, keys: Sequence[str], logit: Column, target: Column, smooth: float = 1e-5) -> DataFrame:
    """1 − (2·Σpy + s) / (Σp + Σy + s) with p = sigmoid(logit), per key."""
    return pixels.groupBy(*keys).agg(_dice_loss(logit, target, smooth))


def focal_loss(pixels: DataFrame, keys: Sequence[str], logit: Column, target: Column, *,
               gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Mean sigmoid focal loss per key."""
    return pixels.groupBy(*keys).agg(_focal_loss(logit, target, gamma, alpha))


def soft_losses(pixels: DataFrame, keys: Sequence[str], logit: Column, target: Column, *,
                smooth: float = 1e-5, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Both losses per key in one aggregate."""
    return pixels.groupBy(*keys).agg(_dice_loss(logit, target, smooth), _focal_loss(logit, target, gamma, alpha))


def score_batches(samples: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Score sample rows with a caller's model, in Arrow batches, giving prediction rows.

    The only Python in the package that sees data: the model itself is the caller's.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return samples.mapInPandas(run, schemas.PREDICTIONS)
