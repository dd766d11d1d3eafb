"""Queries: segmentation scores, conformal calibration and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import conformal as CP
from ..operators import metrics as M
from ..operators import pixels as P
from . import fixtures as X
from .registry import query

_P = X.PREDICTIONS


def _labelled(spark, sf_dir):
    return P.ignore_unlabelled(X.predictions(spark, sf_dir))




def _label():
    return F.col("label") > 0


def _pred():
    return F.col("prob") > 0.5


_CONF = """
conf AS (SELECT case_id, frame, count(*) FILTER (label > 0 AND prob > 0.5) AS tp, count(*) FILTER (label <= 0 AND prob > 0.5) AS fp,
                count(*) FILTER (label > 0 AND prob <= 0.5) AS fn, count(*) FILTER (label <= 0 AND prob <= 0.5) AS tn
         FROM predictions WHERE label <> -1 GROUP BY case_id, frame)"""


@query(f"""
WITH {_P} SELECT case_id, frame, order_id, line, label FROM predictions WHERE label <> -1
""")
def ignore_pixels(spark, sf_dir):
    """Unlabelled pixels dropped."""
    return _labelled(spark, sf_dir).select("case_id", "frame", "order_id", "line", "label")


@query(f"""
WITH {_P}
SELECT case_id, count(*) AS pixels, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS labels,
       CAST(sum(CASE WHEN label <> -1 AND prob > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS preds FROM predictions GROUP BY case_id
""")
def blank_pixels(spark, sf_dir):
    """Unlabelled pixels kept but counted as background on both sides."""
    rows = X.predictions(spark, sf_dir).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
    out = P.blank_unlabelled(rows)
    return out.groupBy("case_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("label").alias("labels"), F.sum("pred").alias("preds"))


def _frames(spark, sf_dir, zero):
    return M.frame_scores(_labelled(spark, sf_dir), ["case_id", "frame"], _label(), _pred(), zero_division=zero)


@query(f"""
WITH {_P}, {_CONF}
SELECT case_id, frame, tp, fp, fn, tn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END, 6) AS iou FROM conf
""")
def confusion_by_frame(spark, sf_dir):
    """Confusion counts, F1 and IoU of every frame."""
    out = _frames(spark, sf_dir, M.ZERO_DIVISION["pred"])
    return out.select("case_id", "frame", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"), F.round("iou", 6).alias("iou"))


_FIRE = f"""
WITH {_P}, {_CONF},
scored AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE {{z}} END AS f1,
                  CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE {{z}} END AS iou FROM conf),
fire AS (SELECT case_id, avg(f1) AS f1, avg(iou) AS iou, CAST(sum(tp + fp) AS BIGINT) AS pred_positive, CAST(sum(tp + fn) AS BIGINT) AS label_positive,
                count(*) FILTER (tp + fp = 0) AS zero_prediction_frames, count(*) AS frames FROM scored GROUP BY case_id)
"""


@query(_FIRE.format(z="0.0") + "SELECT case_id, round(f1, 6) AS f1, round(iou, 6) AS iou, pred_positive, label_positive, zero_prediction_frames, frames FROM fire")
def fire_scores(spark, sf_dir):
    """Mean scores and diagnostics per fire."""
    out = M.fire_scores(_frames(spark, sf_dir, 0.0))
    return out.withColumns({"f1": F.round("f1", 6), "iou": F.round("iou", 6)})


_MACRO_COLS = "count(*) AS evaluated_fires, CAST(sum(pred_positive) AS BIGINT) AS pred_positive, CAST(sum(label_positive) AS BIGINT) AS label_positive, CAST(sum(zero_prediction_frames) AS BIGINT) AS zero_prediction_frames, CAST(sum(frames) AS BIGINT) AS frames"


@query(_FIRE.format(z="0.0") + f"""
SELECT round(sum(f1) / count(*), 6) AS f1, round(sum(iou) / count(*), 6) AS iou, {_MACRO_COLS},
       (SELECT count(*) FROM fire WHERE label_positive = 0) AS skipped_fires FROM fire WHERE label_positive > 0
""")
def macro_scores_growth(spark, sf_dir):
    """Macro mean over fires with a positive label: the next-day growth rule."""
    out = M.macro_scores(M.fire_scores(_frames(spark, sf_dir, 0.0)), drop_empty=True)
    return out.withColumns({"f1": F.round("f1", 6), "iou": F.round("iou", 6)})


@query(_FIRE.format(z="1.0") + f"""
SELECT round(sum(f1) / 17, 6) AS f1, round(sum(iou) / 17, 6) AS iou, {_MACRO_COLS}, CAST(0 AS BIGINT) AS skipped_fires FROM fire
""")
def macro_scores_listed(spark, sf_dir):
    """Macro mean over all 17 listed fires, scored or not: the active-fire rule."""
    out = M.macro_scores(M.fire_scores(_frames(spark, sf_dir, 1.0)), drop_empty=False, listed=len(K.AF_TEST_FIRES))
    return out.withColumns({"f1": F.round("f1", 6), "iou": F.round("iou", 6)})


@query(f"""
WITH {_P}
SELECT order_id, CASE WHEN t > 0 THEN round(t / d, 6) ELSE CASE WHEN d > 0 THEN 0.0 ELSE 1.0 END END AS iou, round(CASE WHEN d > 0 THEN 2 * t / (d + t) ELSE 1.0 END, 6) AS f1
FROM (SELECT order_id, count(*) FILTER (label > 0 AND prob > 0.5) AS t, count(*) FILTER (label > 0 OR prob > 0.5) AS d FROM predictions WHERE label <> -1 GROUP BY order_id)
""")
def window_scores(spark, sf_dir):
    """Validation F1 and IoU per whole sample (orders as samples)."""
    out = M.frame_scores(_labelled(spark, sf_dir), ["order_id"], _label(), _pred(), zero_division=1.0)
    return out.select("order_id", F.round("f1", 6).alias("f1"), F.round("iou", 6).alias("iou"))


@query(f"""
WITH {_P}, {_CONF},
s AS (SELECT case_id, frame, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1.0 END AS i1, CASE WHEN tn + fp + fn > 0 THEN tn / (tn + fp + fn) ELSE 1.0 END AS i0,
             CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1.0 END AS d1, CASE WHEN tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 1.0 END AS d0 FROM conf)
SELECT case_id, frame, round((SELECT avg(x) FROM unnest([i1, i0]) t(x)), 6) AS mean_iou, round((SELECT avg(x) FROM unnest([d1, d0]) t(x)), 6) AS mean_dice FROM s
""")
def class_mean_scores(spark, sf_dir):
    """Mean IoU and Dice over background and fire."""
    out = M.class_scores(_labelled(spark, sf_dir), ["case_id", "frame"], _label(), _pred())
    return out.select("case_id", "frame", F.round("mean_iou", 6).alias("mean_iou"), F.round("mean_dice", 6).alias("mean_dice"))


@query(f"""
WITH {_P}
SELECT case_id, round(avg(CASE WHEN (prob > 1 - prob) = (label > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predictions WHERE label <> -1 GROUP BY case_id
""")
def categorical_accuracy(spark, sf_dir):
    """Share of pixels whose better-scoring class is right."""
    p = F.col("prob")
    out = M.categorical_accuracy(_labelled(spark, sf_dir), ["case_id"], [1 - p, p], _label().cast("int"))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH {_P},
z AS (SELECT case_id, 1 / (1 + exp(-(prob * 4 - 2))) AS p, prob * 4 - 2 AS x, CAST(label > 0 AS DOUBLE) AS y FROM predictions WHERE label <> -1)
SELECT case_id, round(1 - (2 * sum(p * y) + 1e-5) / (sum(p) + sum(y) + 1e-5), 6) AS dice_loss,
       round(avg((0.25 * y + 0.75 * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * -(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS focal_loss FROM z GROUP BY case_id
""")
def soft_losses(spark, sf_dir):
    """Soft Dice and focal loss of scored pixels per case."""
    rows = _labelled(spark, sf_dir).withColumn("logit", F.col("prob") * 4 - 2)
    out = M.soft_losses(rows, ["case_id"], F.col("logit"), _label())
    return out.select("case_id", F.round("dice_loss", 6).alias("dice_loss"), F.round("focal_loss", 6).alias("focal_loss"))


# --- conformal ----------------------------------------------------------------------------------

_SPLIT = f"""
WITH {_P},
cal AS (SELECT *, CASE WHEN label > 0 THEN 1 - prob ELSE prob END AS score FROM predictions WHERE label <> -1 AND order_id % 2 = 0),
test AS (SELECT * FROM predictions WHERE label <> -1 AND order_id % 2 = 1),
ranked AS (SELECT 2 AS g, score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM cal
           UNION ALL SELECT CAST(label > 0 AS INTEGER), score, row_number() OVER (PARTITION BY label > 0 ORDER BY score) - 1, count(*) OVER (PARTITION BY label > 0) FROM cal),
q AS (SELECT g, score AS qhat, n FROM ranked WHERE i = least(CAST(ceil((n + 1) * (1 - 0.1)) AS BIGINT), n - 1)),
qq AS (SELECT max(qhat) FILTER (g = 0) AS q0, max(qhat) FILTER (g = 1) AS q1, max(n) FILTER (g = 1) AS n_pos, max(n) FILTER (g = 0) AS n_neg FROM q)
"""
ALPHA = 0.1


def _calibration(spark, sf_dir):
    return _labelled(spark, sf_dir).where("order_id % 2 = 0")


def _test(spark, sf_dir):
    return _labelled(spark, sf_dir).where("order_id % 2 = 1")


@query(f"""
WITH {_P} SELECT order_id, line, round(CASE WHEN label > 0 THEN 1 - prob ELSE prob END, 6) AS score FROM predictions WHERE label <> -1
""")
def nonconformity(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.select("order_id", "line", F.round(CP.nonconformity(F.col("prob"), _label()), 6).alias("score"))


@query(_SPLIT + "SELECT round(qhat, 6) AS qhat, n FROM q WHERE g = 2")
def conformal_quantile(spark, sf_dir):
    """Exact split-conformal quantile of the calibration half."""
    scores = _calibration(spark, sf_dir).select(CP.nonconformity(F.col("prob"), _label()).alias("score"))
    return CP.conformal_quantile(scores, ALPHA).select(F.round("qhat", 6).alias("qhat"), "n")


@query("""
WITH r AS (SELECT o_orderstatus, o_totalprice / 1000000 AS score, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus AS "group", round(score, 9) AS qhat, n FROM r WHERE i = least(CAST(ceil((n + 1) * (1 - 0.05)) AS BIGINT), n - 1)
""")
def conformal_quantile_distinct(spark, sf_dir):
    """The same rank over scores that hardly repeat, per group."""
    scores = X.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("group"), (F.col("o_totalprice") / 1000000).alias("score"))
    return CP.conformal_quantile(scores, 0.05, by=["group"]).withColumn("qhat", F.round("qhat", 9))


@query(_SPLIT + "SELECT round(q0, 6) AS q0, round(q1, 6) AS q1, n_pos, n_neg FROM qq")
def class_quantiles(spark, sf_dir):
    """Class-conditional quantiles."""
    out = CP.class_quantiles(_calibration(spark, sf_dir), ALPHA)
    return out.select(F.round("q0", 6).alias("q0"), F.round("q1", 6).alias("q1"), "n_pos", "n_neg")


@query(_SPLIT + """
SELECT order_id, line, prob <= q0 AS include_no_fire, 1 - prob <= q1 AS include_fire, prob <= q0 AND 1 - prob <= q1 AS uncertain FROM test, qq
""")
def prediction_sets(spark, sf_dir):
    """Which of {fire, no fire} each test pixel's set holds."""
    q = CP.class_quantiles(_calibration(spark, sf_dir), ALPHA)
    out = CP.prediction_sets(_test(spark, sf_dir), q)
    return out.select("order_id", "line", "include_no_fire", "include_fire", "uncertain")


_REL = _SPLIT + """,
s AS (SELECT case_id, label > 0 AS y, prob >= 0.5 AS b, 1 - prob <= q1 AS f, prob <= q0 AS nf FROM test, qq),
agg AS (SELECT case_id, grouping(case_id) AS g, count(*) AS num_pixels, count(*) FILTER (f <> nf) AS num_confident_pixels, count(*) FILTER (f AND nf) AS num_uncertain_pixels,
        count(*) FILTER (b <> y) AS num_errors_baseline, count(*) FILTER (CASE WHEN y THEN f ELSE nf END) AS covered, count(*) FILTER (b <> y AND f AND nf) AS captured,
        count(*) FILTER (y AND b) AS btp, count(*) FILTER (NOT y AND b) AS bfp, count(*) FILTER (y AND NOT b) AS bfn,
        count(*) FILTER (f <> nf AND y AND f) AS stp, count(*) FILTER (f <> nf AND NOT y AND f) AS sfp, count(*) FILTER (f <> nf AND y AND NOT f) AS sfn
        FROM s GROUP BY GROUPING SETS ((case_id), ())),
rel AS (SELECT CASE g WHEN 1 THEN 'global' ELSE 'case' END AS scope, case_id, covered / num_pixels AS coverage, num_uncertain_pixels / num_pixels AS uncertainty_rate,
        CASE WHEN num_errors_baseline > 0 THEN captured / num_errors_baseline ELSE 0.0 END AS error_capture_rate,
        CASE WHEN btp + bfp + bfn > 0 THEN 2 * btp / (2 * btp + bfp + bfn) ELSE 1.0 END AS baseline_f1, CASE WHEN btp + bfp + bfn > 0 THEN btp / (btp + bfp + bfn) ELSE 1.0 END AS baseline_iou,
        CASE WHEN num_confident_pixels = 0 THEN 'NaN'::DOUBLE WHEN stp + sfp + sfn > 0 THEN 2 * stp / (2 * stp + sfp + sfn) ELSE 1.0 END AS selective_f1,
        CASE WHEN num_confident_pixels = 0 THEN 'NaN'::DOUBLE WHEN stp + sfp + sfn > 0 THEN stp / (stp + sfp + sfn) ELSE 1.0 END AS selective_iou,
        num_pixels, num_confident_pixels, num_uncertain_pixels, num_errors_baseline FROM agg)
"""
_RATIOS = ("coverage", "uncertainty_rate", "error_capture_rate", "baseline_f1", "baseline_iou", "selective_f1", "selective_iou")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _RATIOS)


def _reliability(spark, sf_dir):
    q = CP.class_quantiles(_calibration(spark, sf_dir), ALPHA)
    return CP.reliability(_test(spark, sf_dir), q)


@query(_REL + f"SELECT scope, case_id, {_ROUNDED}, num_pixels, num_confident_pixels, num_uncertain_pixels, num_errors_baseline FROM rel")
def reliability(spark, sf_dir):
    """Reliability per case and over all pixels."""
    out = _reliability(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in _RATIOS})


@query(_REL + "SELECT " + ", ".join(f"round(avg({c}) FILTER (NOT isnan({c})), 6) AS {c}" for c in _RATIOS) + ", count(*) AS num_test_cases FROM rel WHERE scope = 'case'")
def reliability_macro(spark, sf_dir):
    """Mean reliability over cases."""
    out = CP.macro_reliability(_reliability(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in _RATIOS})
