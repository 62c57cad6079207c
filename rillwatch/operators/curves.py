"""Curves and threshold searches over scored rows.

Rows are first grouped by score, so the ordered part is as large as the number of distinct scores; running counts over it
come from :func:`rillwatch.ordering.add_running_totals` and are spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SENSITIVITY_THRESHOLDS, THRESHOLD_STEP
from ..core import col, count_when, join_stats, one_row, ratio
from ..errors import DataError
from ..ordering import add_position, add_running_totals
from .metrics import _f1

_AREA = lambda dfp, tp, dtp: dfp * (tp - dtp / 2)  # trapezoid under the step that ends at tp


def _by_score(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[col(b) for b in by], col(score).alias("threshold")).agg(
        F.count_if(col(y) == 1).alias("pos"), F.count_if(col(y) == 0).alias("neg"))


def _running(grouped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds tp and fp: rows at or above each score, per group, with the totals of the group."""
    order = [*by, F.desc("threshold")]
    run = add_running_totals(grouped, order, {"tp": "pos", "fp": "neg"})
    if not by:
        ends = one_row(run.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))  # from the pinned rows, not the table
        return run.withColumn("_e", ends).select("*", "_e.*").drop("_e")
    ends = run.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    ahead = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    ends = ends.select("*", *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(f"_{t}") for t in ("P", "N")])
    return (join_stats(run, ends, by, "inner").withColumns({"tp": col("tp") - col("_P"), "fp": col("fp") - col("_N")}).drop("_P", "_N"))


def roc_points(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fpr, tpr): one point per distinct score, and the origin with threshold 1."""
    run = _running(_by_score(df, y, score, by), by)
    points = run.select(*by, "threshold", ratio(col("fp"), col("N")).alias("fpr"), ratio(col("tp"), col("P")).alias("tpr"))
    groups = run.select(*by).distinct() if by else df.sparkSession.range(1).select()
    origin = groups.select(*by, F.lit(1.0).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)


def roc_points_by_row(df: DataFrame, y: str, score: str, key: Sequence[str]) -> DataFrame:
    """One point per row in (score descending, key) order, ties not grouped: position 0 is the origin."""
    flagged = df.select(*key, score, (col(y) == 1).cast("bigint").alias("pos"), (col(y) == 0).cast("bigint").alias("neg"))
    order = [F.desc(score), *key]
    run = add_running_totals(flagged, order, {"tp": "pos", "fp": "neg"})
    ends = one_row(run.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    points = run.withColumn("_e", ends).select(
        (col("tp") + col("fp")).alias("position"), col(score).alias("threshold"),
        ratio(col("fp"), F.col("_e.N")).alias("fpr"), ratio(col("tp"), F.col("_e.P")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("position"), F.lit(1.0).alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc, support): area by trapezoids over grouped ties; 0.5 where only one class occurs."""
    run = _running(_by_score(df, y, score, by), by)
    area = F.sum(_AREA(col("neg"), col("tp"), col("pos")))
    both = (F.max("P") > 0) & (F.max("N") > 0)
    auc = F.when(both, area / (F.max("P").cast("double") * F.max("N"))).otherwise(0.5)
    return run.groupBy(*by).agg(auc.alias("auc"), F.max("P").alias("support"))


def roc_auc_by_row(df: DataFrame, y: str, score: str, key: Sequence[str]) -> DataFrame:
    """One row ``auc`` with ties kept in key order, as a row-by-row curve has it."""
    flagged = df.select(*key, score, (col(y) == 1).cast("bigint").alias("pos"), (col(y) == 0).cast("bigint").alias("neg"))
    run = add_running_totals(flagged, [F.desc(score), *key], {"tp": "pos"})
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return run.agg(F.when(both, F.sum(_AREA(col("neg"), col("tp"), col("pos"))) / (F.sum("pos").cast("double") * F.sum("neg")))
                   .otherwise(0.5).alias("auc"))


def one_vs_rest(df: DataFrame, true: str, scores: str) -> DataFrame:
    """(class, y, score) from a map of scores per class: one row per row and class."""
    return df.select(col(true).alias("_true"), F.explode(col(scores)).alias("class", "score")).select(
        "class", (col("_true") == col("class")).cast("int").alias("y"), "score")


def multiclass_auc(df: DataFrame, true: str, scores: str) -> DataFrame:
    """(class, auc, support, weighted_auc) one-vs-rest, weighted by support."""
    per = roc_auc(one_vs_rest(df, true, scores), "y", "score", ["class"]).filter("support > 0")
    total = per.agg(ratio(F.sum(col("auc") * col("support")), F.sum("support")).alias("weighted"))
    return per.withColumn("weighted_auc", one_row(total).getField("weighted"))


def _quality(metric: str, tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    known = {"f1": _f1(p, r), "precision": p, "recall": r, "accuracy": ratio(tp + tn, tp + fp + fn + tn),
             "youden": r - ratio(fp, fp + tn)}
    if metric not in known:
        raise DataError(f"unknown metric: {metric}")
    return known[metric]


def best_threshold(df: DataFrame, y: str, score: str, metric: str = "f1") -> DataFrame:
    """One row (threshold, score): best distinct score as ``>=`` threshold, the lowest on ties; (0.5, 0) if none is above 0."""
    run = _running(_by_score(df, y, score))
    q = _quality(metric, col("tp"), col("fp"), col("P") - col("tp"), col("N") - col("fp"))
    top = run.select("threshold", q.alias("score")).filter("score > 0").agg(
        F.max(F.struct(col("score"), (-col("threshold")).alias("t"))).alias("best"))
    return top.select(F.coalesce(-F.col("best.t"), F.lit(0.5)).alias("threshold"),
                      F.coalesce(F.col("best.score"), F.lit(0.0)).alias("score"))


# --- fixed thresholds -----------------------------------------------------------------------------------------------

def _below(score: Column, n: int, low: float, step: float, strict: bool) -> Column:
    """How many of the ascending thresholds low + i * step (i < n) the score passes.

    The index is guessed by division and put right by comparing with the neighbouring thresholds themselves.
    """
    guess = F.greatest(F.least(F.floor((score - low) / step), F.lit(n)), F.lit(0)).cast("int")
    passes = lambda i: (i >= 0) & (i < n) & (F.lit(low) + i * step < score if strict else F.lit(low) + i * step <= score)
    start = F.greatest(guess - 1, F.lit(0))
    return start + passes(start).cast("int") + passes(start + 1).cast("int") + passes(start + 2).cast("int")


def _counts_per_threshold(df: DataFrame, y: str, passed: Column, n: int) -> DataFrame:
    """(i, tp, fp, P, N) per threshold index from the number of thresholds each row passes: one pass, n + 1 groups."""
    counted = df.groupBy(passed.alias("k")).agg(F.count_if(col(y) == 1).alias("pos"), F.count_if(col(y) == 0).alias("neg"))
    grid = df.sparkSession.range(n + 1).select(col("id").cast("int").alias("k"))
    full = grid.join(counted, "k", "left").na.fill(0)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # n + 1 rows
    everything = Window.partitionBy()
    return full.select((col("k") - 1).alias("i"), F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
                       F.sum("pos").over(everything).alias("P"), F.sum("neg").over(everything).alias("N")).filter("i >= 0")


def _measured(counts: DataFrame, threshold: Column) -> DataFrame:
    tp, fp = col("tp"), col("fp")
    fn, tn = col("P") - tp, col("N") - fp
    return counts.select(threshold.alias("threshold"), *[
        _quality(m, tp, fp, fn, tn).alias(m) for m in ("f1", "precision", "recall", "accuracy")],
        (tp + fp).alias("n_anomalies"), ratio(tp + fp, col("P") + col("N")).alias("anomaly_rate"), "i")


def threshold_grid(df: DataFrame, y: str, score: str, step: float = THRESHOLD_STEP, low: float = 0.0, high: float = 1.0,
                   strict: bool = True) -> DataFrame:
    """Metrics at every threshold low, low + step, ... up to high."""
    n = math.ceil(round((high + step - low) / step, 6))  # the length of the half-open range low, low + step, ..., high + step
    passed = _below(col(score), n, low, step, strict)
    return _measured(_counts_per_threshold(df, y, passed, n), F.lit(low) + col("i") * step)


def search_threshold(df: DataFrame, y: str, score: str, metric: str = "f1", step: float = THRESHOLD_STEP, low: float = 0.0,
                     high: float = 1.0) -> DataFrame:
    """One row: the first best threshold of the grid (score ``>`` threshold) with all metrics at it."""
    if metric not in ("f1", "precision", "recall"):
        raise DataError(f"unknown metric: {metric}")
    grid = threshold_grid(df, y, score, step, low, high)
    best = grid.orderBy(F.desc(metric), "threshold").limit(1)
    return best.withColumns({"optimization_metric": F.lit(metric), "optimization_score": col(metric)}).drop("i")


def sensitivity(df: DataFrame, y: str, score: str, thresholds: Sequence[float] = tuple(SENSITIVITY_THRESHOLDS)) -> DataFrame:
    """Metrics at a few given thresholds (score ``>`` threshold)."""
    ordered = sorted(thresholds)
    passed = sum((F.when(col(score) > t, 1).otherwise(0) for t in ordered), F.lit(0))
    values = F.element_at(F.array(*[F.lit(float(t)) for t in ordered]), col("i") + 1)
    return _measured(_counts_per_threshold(df, y, passed, len(ordered)), values).drop("i")


def threshold_curve(df: DataFrame, y: str, score: str, points: int = 200) -> DataFrame:
    """(threshold, precision, recall, f1, best) at evenly spaced thresholds (score ``>=``); best marks the first maximum of F1."""
    step = 1.0 / (points - 1)
    passed = _below(col(score), points, 0.0, step, strict=False)
    curve = _measured(_counts_per_threshold(df, y, passed, points), col("i") * step)
    first = F.row_number().over(Window.orderBy(F.desc("f1"), "threshold")) == 1  # as many rows as points
    return curve.select("threshold", "precision", "recall", "f1", first.alias("best"))


def precision_recall(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (1, 0) without threshold."""
    run = _running(_by_score(df, y, score))
    points = run.select("threshold", ratio(col("tp"), col("tp") + col("fp")).alias("precision"),
                        ratio(col("tp"), col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                                          F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def precision_recall_summary(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: area under the curve by trapezoids over recall, and the point of the best F1.

    The neighbour of a point is the one before it in the running counts, so no second ordering is needed.
    """
    run = _running(_by_score(df, y, score))
    p = ratio(col("tp"), col("tp") + col("fp"))
    before_tp, before_fp = col("tp") - col("pos"), col("fp") - col("neg")
    before_p = F.when(before_tp + before_fp > 0, ratio(before_tp, before_tp + before_fp)).otherwise(1.0)
    area = F.sum(F.try_divide(col("pos").cast("double"), col("P")) * (p + before_p) / 2)
    r = ratio(col("tp"), col("P"))
    f1 = F.try_divide(2 * p * r, p + r + 1e-10)
    best = F.max(F.struct(f1.alias("f1"), (-col("threshold")).alias("t")))
    return run.agg(area.alias("pr_auc"), best.alias("b")).select("pr_auc", (-F.col("b.t")).alias("threshold"),
                                                                 F.col("b.f1").alias("f1"))


def backtest(df: DataFrame, order: Sequence[str], true: str, pred: str, window_size: int = 100) -> DataFrame:
    """Per window of consecutive rows: samples, counts and accuracy. Pool them, or evaluate ``df``, for the whole."""
    placed = add_position(df, order)
    t, p = col(true), col(pred)
    per = placed.groupBy(F.floor(col("position") / window_size).alias("window_id")).agg(
        F.count(F.lit(1)).alias("samples"), count_when((p == 1) & (t == 1)).alias("tp"), count_when((p == 1) & (t == 0)).alias("fp"),
        count_when((p == 0) & (t == 1)).alias("fn"), count_when((p == 0) & (t == 0)).alias("tn"))
    return per.withColumn("accuracy", ratio(col("tp") + col("tn"), col("samples")))
