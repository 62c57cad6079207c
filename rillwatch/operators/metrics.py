"""Evaluation metrics. Everything starts from the counts per (true, pred) pair: one small shuffle, then class-sized work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import col, count_when, one_row, pin, ratio
from ..quantiles import quantile_row


def align(truth: DataFrame, prediction: DataFrame, key: Sequence[str]) -> DataFrame:
    """Truth and prediction side by side by key: rows have no position to zip by."""
    return truth.join(prediction, list(key))


def pair_counts(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(true, pred, n): everything below reads this instead of the rows."""
    return df.groupBy(col(true).alias("true"), col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.agg(F.avg((col(true) == col(pred)).cast("double")).alias("accuracy"))


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def class_report(pairs: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, tn, support, precision, recall, f1_score); accuracy of a class is its recall."""
    total = one_row(pairs.agg(F.sum("n").alias("n"))).getField("n")
    hit = col("true") == col("pred")
    sides = pairs.select(F.explode(F.array(
        F.struct(col("true").alias("class"), F.when(hit, col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                 F.when(hit, 0).otherwise(col("n")).alias("fn")),
        F.struct(col("pred").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.when(hit, 0).otherwise(col("n")).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn")))).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = ratio(col("tp"), col("tp") + col("fp")), ratio(col("tp"), col("tp") + col("fn"))
    return (per.withColumns({"tn": total - col("tp") - col("fp") - col("fn"), "support": col("tp") + col("fn"),
                             "precision": p, "recall": r}).withColumn("f1_score", _f1(col("precision"), col("recall"))))


def averaged(report: DataFrame, average: str = "weighted") -> DataFrame:
    """One row precision, recall, f1_score: by support, or the plain mean for any other name."""
    names = ["precision", "recall", "f1_score"]
    if average == "weighted":
        return report.agg(*[ratio(F.sum(col(m) * col("support")), F.sum("support")).alias(m) for m in names])
    return report.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in names])


def overall(report: DataFrame) -> DataFrame:
    """One row: accuracy, samples, classes, weighted and macro averages."""
    weight = lambda m: ratio(F.sum(col(m) * col("support")), F.sum("support"))
    names = ["precision", "recall", "f1_score"]
    return report.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.sum("support").alias("total_samples"),
                      F.count(F.lit(1)).alias("n_classes"), *[weight(m).alias(f"weighted_{m}") for m in names],
                      *[F.avg(m).alias(f"macro_{m}") for m in names])


def confusion_matrix(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """(true, pred, n) for every cell of the label grid, empty cells as 0; pairs outside given labels are ignored."""
    if labels is not None:
        grid = pairs.sparkSession.createDataFrame([(list(labels),)], "labels array<string>")
    else:
        grid = (pairs.select(F.explode(F.array("true", "pred")).alias("label")).distinct()
                .agg(F.array_sort(F.collect_list("label")).alias("labels")))  # one entry per class
    cells = grid.select(F.explode("labels").alias("true"), "labels").select("true", F.explode("labels").alias("pred"))
    return cells.join(pairs, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def matrix_breakdown(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, tn, support) from the cells of a matrix, over the labels of the matrix only."""
    total = one_row(matrix.agg(F.sum("n").alias("n"))).getField("n")
    row, column = Window.partitionBy("true"), Window.partitionBy("pred")  # as many rows as classes each
    sums = matrix.select("true", "pred", "n", F.sum("n").over(row).alias("r"), F.sum("n").over(column).alias("c"))
    return sums.filter(col("true") == col("pred")).select(
        col("true").alias("label"), col("n").alias("tp"), (col("c") - col("n")).alias("fp"), (col("r") - col("n")).alias("fn"),
        (total - col("r") - col("c") + col("n")).alias("tn"), col("r").alias("support"))


def confusion_shares(matrix: DataFrame) -> DataFrame:
    share = F.try_divide(col("n"), F.sum("n").over(Window.partitionBy("true")))
    return matrix.select("true", "pred", "n", share.alias("share"))


def confusion_table(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Wide form: ``actual`` and one ``pred_{label}`` column per label."""
    return matrix.groupBy(col("true").alias("actual")).agg(*[
        F.coalesce(F.sum(F.when(col("pred") == l, col("n"))), F.lit(0)).alias(f"pred_{l}") for l in labels])


def false_positive_rate(pairs: DataFrame, target: str) -> DataFrame:
    other = col("true") != target
    wrong = F.sum(F.when(other & (col("pred") == target), col("n")))
    return pairs.agg(ratio(F.coalesce(wrong, F.lit(0)), F.sum(F.when(other, col("n")))).alias("false_positive_rate"))


def evaluation(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Long form (section, class, metric, value): summary, per-class metrics and matrix from one scan of the rows."""
    pairs = pin(pair_counts(df, true, pred))  # one pass over the rows; everything below is as large as the classes
    report = class_report(pairs)
    summary = overall(report)
    entry = lambda section, cls, name, value: F.struct(
        F.lit(section).alias("section"), cls.alias("class"), name.alias("metric"), value.cast("double").alias("value"))
    top = {"accuracy": "accuracy", "precision": "weighted_precision", "recall": "weighted_recall", "f1_score": "weighted_f1_score",
           "total_samples": "total_samples"}
    a = summary.select(F.inline(F.array(*[entry("summary", F.lit(""), F.lit(m), col(c)) for m, c in top.items()])))
    names = ["precision", "recall", "f1_score", "support", "tp", "fp", "fn", "tn"]
    b = report.select(F.inline(F.array(*[entry("per_class", col("class"), F.lit(m), col(m)) for m in names])))
    c = confusion_matrix(pairs).select(F.inline(F.array(entry("confusion", col("true"), col("pred"), col("n")))))
    return a.unionAll(b).unionAll(c)


# --- anomaly detection ----------------------------------------------------------------------------------------------

def _binary(true: Column, pred: Column) -> dict[str, Column]:
    tp, fp = count_when((pred == 1) & (true == 1)), count_when((pred == 1) & (true == 0))
    fn, tn = count_when((pred == 0) & (true == 1)), count_when((pred == 0) & (true == 0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn}


def anomaly_report(df: DataFrame, true: str, pred: str, score: str | None = None) -> DataFrame:
    """One row: detection and false-alarm rate, precision, F1, accuracy, counts, base rate, and score statistics."""
    b = _binary(col(true), col(pred))
    tp, fp, fn, tn = b["tp"], b["fp"], b["fn"], b["tn"]
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    extra = []
    if score:
        median = one_row(quantile_row(df, [score], [0.5])).getField(f"{score}@0.5")
        extra = [F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"), F.min(score).alias("score_min"),
                 F.max(score).alias("score_max")]
    out = df.agg(r.alias("detection_rate"), ratio(fp, fp + tn).alias("false_alarm_rate"), p.alias("precision"),
                 _f1(p, r).alias("f1_score"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                 tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), tn.alias("true_negatives"),
                 F.count(F.lit(1)).alias("total_samples"), F.coalesce(F.avg(true), F.lit(0.0)).alias("anomaly_ratio"), *extra)
    return out.withColumn("score_median", median) if score else out


def attack_report(df: DataFrame, true: str, pred: str, attack: str) -> DataFrame:
    """(attack, detection_rate, false_alarm_rate, support)."""
    b = _binary(col(true), col(pred))
    return df.groupBy(col(attack).alias("attack")).agg(ratio(b["tp"], b["tp"] + b["fn"]).alias("detection_rate"),
                                                      ratio(b["fp"], b["fp"] + b["tn"]).alias("false_alarm_rate"),
                                                      F.count(F.lit(1)).alias("support"))


def detector_summary(df: DataFrame, score: str, flag: str, true: str | None = None) -> DataFrame:
    """One row about the raw scores of a detector; metrics are added when the truth is known."""
    out = [F.count(F.lit(1)).alias("n_samples"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
           F.min(score).alias("min_score"), F.max(score).alias("max_score"),
           count_when(col(flag) == 1).alias("n_predicted_anomalies"), count_when(col(flag) == 0).alias("n_predicted_normal"),
           F.avg((col(flag) == 1).cast("double")).alias("anomaly_rate")]
    if true:
        b = _binary(col(true), col(flag))
        p, r = ratio(b["tp"], b["tp"] + b["fp"]), ratio(b["tp"], b["tp"] + b["fn"])
        out += [ratio(b["tp"] + b["tn"], F.count(F.lit(1))).alias("accuracy"), p.alias("precision"), r.alias("recall"),
                _f1(p, r).alias("f1"), *[b[k].alias(k) for k in ("tn", "fp", "fn", "tp")]]
    return df.agg(*out)


def calibration(df: DataFrame, true: str, pred: str, confidence: str, bins: int = 10) -> DataFrame:
    """(bin, accuracy, confidence, n, ece): bins [lo, hi), so a confidence of 1 is in none; ece repeats on each row."""
    edges = [i / bins for i in range(1, bins)]
    place = sum((F.when(col(confidence) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    inside = df.filter((col(confidence) >= 0) & (col(confidence) < 1))
    per = inside.groupBy(place.alias("bin")).agg(F.avg((col(true) == col(pred)).cast("double")).alias("accuracy"),
                                                 F.avg(confidence).alias("confidence"), F.count(F.lit(1)).alias("n"))
    gap = per.agg(ratio(F.sum(col("n") * F.abs(col("accuracy") - col("confidence"))), F.sum("n")).alias("ece"))
    return per.withColumn("ece", one_row(gap).getField("ece"))


def model_comparison(reports: DataFrame) -> DataFrame:
    """Rounded comparison table; one row per model."""
    return reports.select(F.coalesce("name", F.lit("Unknown")).alias("name"), *[
        F.round(F.coalesce(col(m), F.lit(0.0)), 4).alias(m) for m in ("accuracy", "f1_score", "detection_rate", "false_alarm_rate")],
        F.coalesce(col("trained_at").cast("string"), F.lit("N/A")).alias("trained_at"))


def alert_table(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.coalesce(col("timestamp").cast("string"), F.lit("N/A")).alias("timestamp"),
                         F.coalesce("severity", F.lit("unknown")).alias("severity"),
                         F.coalesce("predicted_class", F.lit("UNKNOWN")).alias("predicted_class"),
                         F.round(F.coalesce("anomaly_score", F.lit(0.0)), 4).alias("anomaly_score"),
                         F.coalesce("is_zero_day", F.lit(False)).alias("is_zero_day"))


def evaluation_report(df: DataFrame, name: str, true: str = "y_true", pred: str = "y_pred", roc_auc: Column | None = None,
                      metadata: dict[str, str] | None = None, latency: DataFrame | None = None,
                      throughput: DataFrame | None = None, kind: str = "report_name") -> DataFrame:
    """One row with the nested report: summary, per-class metrics, matrix cells, optional latency and throughput.

    The arrays hold one entry per class, per cell of the class grid and per operation.
    """
    pairs = pin(pair_counts(df, true, pred))  # one pass over the rows; everything below is as large as the classes
    report = class_report(pairs)
    summary = overall(report)
    listed = lambda frame, order: one_row(frame.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))).getField("rows")
    fields = [F.lit(name).alias(kind), F.struct(
        "accuracy", col("weighted_precision").alias("precision"), col("weighted_recall").alias("recall"),
        col("weighted_f1_score").alias("f1_score"), "total_samples",
        *([roc_auc.alias("roc_auc")] if roc_auc is not None else [])).alias("summary"),
        listed(report, ["class", "precision", "recall", "f1_score", "support", "tp", "fp", "fn", "tn"]).alias("per_class"),
        listed(confusion_matrix(pairs), ["true", "pred", "n"]).alias("confusion_matrix")]
    if metadata is not None:
        fields.insert(1, F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]).alias("metadata"))
    if latency is not None:
        fields.append(listed(latency, latency.columns).alias("latency"))
    if throughput is not None:
        fields.append(listed(throughput, throughput.columns).alias("throughput"))
    return summary.select(*fields)
