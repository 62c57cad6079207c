"""Queries over evaluation metrics, curves and threshold searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import col
from ..operators import curves, metrics
from .inputs import JUDGED, judged
from .registry import query, rounded, sql_rnd

_Q = "CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 0.0 END"
_REPORT = f"""
  p AS (SELECT y_true, y_pred, count(*) AS n FROM d GROUP BY ALL),
  c AS (SELECT class, CAST(sum(CASE WHEN y_true = class AND y_pred = class THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y_true <> class AND y_pred = class THEN n ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN y_true = class AND y_pred <> class THEN n ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN y_true <> class AND y_pred <> class THEN n ELSE 0 END) AS BIGINT) AS tn
        FROM p, (SELECT DISTINCT y_true AS class FROM p UNION SELECT DISTINCT y_pred FROM p) k GROUP BY class),
  q AS (SELECT *, tp + fn AS support, {_Q.format(a='tp', b='tp + fp')} AS precision, {_Q.format(a='tp', b='tp + fn')} AS recall FROM c),
  r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM q)"""
_WITH = f"WITH d AS ({JUDGED}), {_REPORT}"


@query("accuracy", f"SELECT {sql_rnd('avg((y_true = y_pred)::INT)')} AS accuracy FROM ({JUDGED}) d")
def _(spark, folder):
    return rounded(metrics.accuracy(judged(spark, folder)))


@query("aligned_by_key", f"SELECT event_id, y_true, y_pred FROM ({JUDGED}) d")
def _(spark, folder):
    j = judged(spark, folder)
    return metrics.align(j.select("event_id", "y_true"), j.select("event_id", "y_pred"), ["event_id"])


@query("class_report", f"{_WITH} SELECT class, tp, fp, fn, tn, support, {sql_rnd('precision')} AS precision, {sql_rnd('recall')} AS recall, {sql_rnd('f1_score')} AS f1_score FROM r")
def _(spark, folder):
    return rounded(metrics.class_report(metrics.pair_counts(judged(spark, folder))))


_METRICS = ("precision", "recall", "f1_score")


@query("averaged_metrics", f"""{_WITH} SELECT 'weighted' AS average, {', '.join(sql_rnd(f'sum({m} * support) / sum(support)') + f' AS {m}' for m in _METRICS)} FROM r
  UNION ALL SELECT 'macro', {', '.join(sql_rnd(f'avg({m})') for m in _METRICS)} FROM r""")
def _(spark, folder):
    report = metrics.class_report(metrics.pair_counts(judged(spark, folder)))
    return rounded(metrics.averaged(report, "weighted").select(F.lit("weighted").alias("average"), "*").unionAll(
        metrics.averaged(report, "macro").select(F.lit("macro").alias("average"), "*")))


@query("classifier_report", f"""{_WITH} SELECT {sql_rnd('sum(tp) / sum(support)')} AS accuracy, CAST(sum(support) AS BIGINT) AS total_samples, count(*) AS n_classes,
  {', '.join(sql_rnd(f'sum({m} * support) / sum(support)') + f' AS weighted_{m}' for m in _METRICS)}, {', '.join(sql_rnd(f'avg({m})') + f' AS macro_{m}' for m in _METRICS)} FROM r""")
def _(spark, folder):
    return rounded(metrics.overall(metrics.class_report(metrics.pair_counts(judged(spark, folder)))))


_MATRIX = """m AS (SELECT a.l AS "true", b.l AS pred, coalesce(p.n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN p ON p.y_true = a.l AND p.y_pred = b.l)"""
_ALL_LABELS = "k AS (SELECT DISTINCT y_true AS l FROM p UNION SELECT DISTINCT y_pred FROM p)"
_SOME_LABELS = "k AS (SELECT unnest(['BENIGN', 'DoS Hulk', 'Heartbleed', 'Never']) AS l)"
_SOME = ["BENIGN", "DoS Hulk", "Heartbleed", "Never"]


@query("confusion_matrix", f'{_WITH}, {_ALL_LABELS}, {_MATRIX} SELECT * FROM m')
def _(spark, folder):
    return metrics.confusion_matrix(metrics.pair_counts(judged(spark, folder)))


@query("confusion_matrix_given_labels", f'{_WITH}, {_SOME_LABELS}, {_MATRIX} SELECT * FROM m')
def _(spark, folder):
    return metrics.confusion_matrix(metrics.pair_counts(judged(spark, folder)), _SOME)


@query("confusion_breakdown", f"""{_WITH}, {_SOME_LABELS}, {_MATRIX},
  s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY "true") AS BIGINT) AS rs, CAST(sum(n) OVER (PARTITION BY pred) AS BIGINT) AS cs, CAST(sum(n) OVER () AS BIGINT) AS t FROM m)
  SELECT "true" AS label, n AS tp, cs - n AS fp, rs - n AS fn, t - rs - cs + n AS tn, rs AS support FROM s WHERE "true" = pred""")
def _(spark, folder):
    return metrics.matrix_breakdown(metrics.confusion_matrix(metrics.pair_counts(judged(spark, folder)), _SOME))


@query("confusion_shares", f"""{_WITH}, {_ALL_LABELS}, {_MATRIX} SELECT "true", pred, n, {sql_rnd('n / NULLIF(sum(n) OVER (PARTITION BY "true"), 0)')} AS share FROM m""")
def _(spark, folder):
    return rounded(metrics.confusion_shares(metrics.confusion_matrix(metrics.pair_counts(judged(spark, folder)))))


@query("confusion_table", f"""{_WITH}, {_SOME_LABELS}, {_MATRIX} SELECT "true" AS actual, {', '.join(f"CAST(sum(n) FILTER (pred = '{l}') AS BIGINT) AS \"pred_{l}\"" for l in _SOME)} FROM m GROUP BY 1""")
def _(spark, folder):
    return metrics.confusion_table(metrics.confusion_matrix(metrics.pair_counts(judged(spark, folder)), _SOME), _SOME)


@query("false_positive_rate", f"SELECT {sql_rnd('''count(*) FILTER (y_true <> 'DoS Hulk' AND y_pred = 'DoS Hulk') / count(*) FILTER (y_true <> 'DoS Hulk')::DOUBLE''')} AS false_positive_rate FROM ({JUDGED}) d")
def _(spark, folder):
    return rounded(metrics.false_positive_rate(metrics.pair_counts(judged(spark, folder)), "DoS Hulk"))


_EVALUATION = f"""{_WITH}, {_ALL_LABELS}, {_MATRIX},
  o AS (SELECT sum(tp) / sum(support) AS accuracy, {', '.join(f'sum({m} * support) / sum(support) AS {m}' for m in _METRICS)}, sum(support)::DOUBLE AS total_samples FROM r)
  SELECT 'summary' AS section, '' AS class, unnest(['accuracy', 'precision', 'recall', 'f1_score', 'total_samples']) AS metric, round(unnest([accuracy, precision, recall, f1_score, total_samples]), 6) AS value FROM o
  UNION ALL SELECT 'per_class', class, unnest(['precision', 'recall', 'f1_score', 'support', 'tp', 'fp', 'fn', 'tn']), round(unnest([precision, recall, f1_score, support, tp, fp, fn, tn]), 6) FROM r
  UNION ALL SELECT 'confusion', "true", pred, n::DOUBLE FROM m"""


@query("full_evaluation", _EVALUATION)
def _(spark, folder):
    return rounded(metrics.evaluation(judged(spark, folder)))


_FLAG = f"SELECT *, CASE WHEN score > 0.3 THEN 1 ELSE 0 END AS flag FROM ({JUDGED}) j"


def _flagged(spark, folder):
    return judged(spark, folder).withColumn("flag", F.when(col("score") > 0.3, 1).otherwise(0))


_TP, _FP = "count(*) FILTER (flag = 1 AND y = 1)", "count(*) FILTER (flag = 1 AND y = 0)"
_FN, _TN = "count(*) FILTER (flag = 0 AND y = 1)", "count(*) FILTER (flag = 0 AND y = 0)"
_P, _R = f"({_TP} / ({_TP} + {_FP})::DOUBLE)", f"({_TP} / ({_TP} + {_FN})::DOUBLE)"


@query("anomaly_report", f"""SELECT {sql_rnd(_R)} AS detection_rate, {sql_rnd(f'{_FP} / ({_FP} + {_TN})::DOUBLE')} AS false_alarm_rate, {sql_rnd(_P)} AS precision, {sql_rnd(f'2 * {_P} * {_R} / ({_P} + {_R})')} AS f1_score,
  {sql_rnd(f'({_TP} + {_TN}) / count(*)::DOUBLE')} AS accuracy, {_TP} AS true_positives, {_FP} AS false_positives, {_FN} AS false_negatives, {_TN} AS true_negatives, count(*) AS total_samples,
  {sql_rnd('avg(y)')} AS anomaly_ratio, {sql_rnd('avg(score)')} AS score_mean, {sql_rnd('stddev_pop(score)')} AS score_std, min(score) AS score_min, max(score) AS score_max, {sql_rnd('quantile_cont(score, 0.5)')} AS score_median FROM ({_FLAG}) d""".replace("min(score) AS", "round(min(score), 6) AS").replace("max(score) AS", "round(max(score), 6) AS"))
def _(spark, folder):
    return rounded(metrics.anomaly_report(_flagged(spark, folder), "y", "flag", "score"))


@query("attack_report", f"""SELECT y_true AS attack, {sql_rnd(f'CASE WHEN {_TP} + {_FN} > 0 THEN {_TP} / ({_TP} + {_FN})::DOUBLE ELSE 0.0 END')} AS detection_rate,
  {sql_rnd(f'CASE WHEN {_FP} + {_TN} > 0 THEN {_FP} / ({_FP} + {_TN})::DOUBLE ELSE 0.0 END')} AS false_alarm_rate, count(*) AS support FROM ({_FLAG}) d GROUP BY y_true""")
def _(spark, folder):
    return rounded(metrics.attack_report(_flagged(spark, folder), "y", "flag", "y_true"))


@query("detector_summary", f"""SELECT count(*) AS n_samples, {sql_rnd('avg(score)')} AS mean_score, {sql_rnd('stddev_pop(score)')} AS std_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
  count(*) FILTER (flag = 1) AS n_predicted_anomalies, count(*) FILTER (flag = 0) AS n_predicted_normal, {sql_rnd('avg(flag)')} AS anomaly_rate, {sql_rnd(f'({_TP} + {_TN}) / count(*)::DOUBLE')} AS accuracy,
  {sql_rnd(_P)} AS precision, {sql_rnd(_R)} AS recall, {sql_rnd(f'2 * {_P} * {_R} / ({_P} + {_R})')} AS f1, {_TN} AS tn, {_FP} AS fp, {_FN} AS fn, {_TP} AS tp FROM ({_FLAG}) d""")
def _(spark, folder):
    return rounded(metrics.detector_summary(_flagged(spark, folder), "score", "flag", "y"))


@query("calibration", f"""
  WITH d AS ({JUDGED}), b AS (SELECT len([e for e in [{', '.join(str(i / 10) for i in range(1, 10))}] if confidence >= e]) AS bin, (y_true = y_pred)::INT AS hit, confidence FROM d WHERE confidence >= 0 AND confidence < 1),
       g AS (SELECT CAST(bin AS INTEGER) AS bin, avg(hit) AS accuracy, avg(confidence) AS confidence, count(*) AS n FROM b GROUP BY bin)
  SELECT bin, {sql_rnd('accuracy')} AS accuracy, {sql_rnd('confidence')} AS confidence, n, {sql_rnd('(SELECT sum(n * abs(accuracy - confidence)) / sum(n) FROM g)')} AS ece FROM g""")
def _(spark, folder):
    return rounded(metrics.calibration(judged(spark, folder), "y_true", "y_pred", "confidence"))


@query("model_comparison", f"""
  SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'Unknown' END AS name, round(avg((y_true = y_pred)::INT), 4) AS accuracy, 0.0::DOUBLE AS f1_score, round(avg(flag) FILTER (y = 1), 4) AS detection_rate,
         round(avg(flag) FILTER (y = 0), 4) AS false_alarm_rate, 'N/A' AS trained_at FROM ({_FLAG}) d GROUP BY 1""")
def _(spark, folder):
    per = _flagged(spark, folder).groupBy(F.when(col("event_id") % 2 == 0, "even").alias("name")).agg(
        F.avg((col("y_true") == col("y_pred")).cast("double")).alias("accuracy"), F.lit(None).cast("double").alias("f1_score"),
        F.avg(F.when(col("y") == 1, col("flag"))).alias("detection_rate"), F.avg(F.when(col("y") == 0, col("flag"))).alias("false_alarm_rate"),
        F.lit(None).cast("string").alias("trained_at"))
    return metrics.model_comparison(per)


@query("evaluation_report", f"""{_WITH}, o AS (SELECT sum(tp) / sum(support) AS accuracy, sum(f1_score * support) / sum(support) AS f1, CAST(sum(support) AS BIGINT) AS total FROM r)
  SELECT 'nightly' AS report_name, {sql_rnd('accuracy')} AS accuracy, {sql_rnd('f1')} AS f1_score, total AS total_samples, (SELECT CAST(count(*) AS INTEGER) FROM r) AS classes,
         (SELECT CAST(count(*) * count(*) AS INTEGER) FROM r) AS cells, (SELECT CAST(sum(n) AS BIGINT) FROM p) AS cell_total FROM o""")
def _(spark, folder):
    r = metrics.evaluation_report(judged(spark, folder), "nightly", metadata={"table": "events"})
    total = F.aggregate("confusion_matrix", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return rounded(r.select("report_name", "summary.accuracy", "summary.f1_score", "summary.total_samples", F.size("per_class").alias("classes"),
                            F.size("confusion_matrix").alias("cells"), total.alias("cell_total")))


# --- curves ---------------------------------------------------------------------------------------------------------

_CUM = f"""WITH d AS ({JUDGED}), g AS (SELECT score AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM d GROUP BY score),
  u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g WINDOW w AS (ORDER BY threshold DESC))"""


@query("roc_points", f"{_CUM} SELECT 1.0::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT round(threshold, 6), {sql_rnd('fp / N')}, {sql_rnd('tp / P')} FROM u")
def _(spark, folder):
    return rounded(curves.roc_points(judged(spark, folder), "y", "score"))


_ROWS = f"""WITH d AS ({JUDGED}), u AS (SELECT score, y, row_number() OVER w AS position, sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp, sum(y) OVER () AS P, sum(1 - y) OVER () AS N
  FROM d WINDOW w AS (ORDER BY score DESC, event_id))"""


@query("roc_points_by_row", f"{_ROWS} SELECT 0::BIGINT AS position, 1.0::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT position, round(score, 6), {sql_rnd('fp / N')}, {sql_rnd('tp / P')} FROM u")
def _(spark, folder):
    return rounded(curves.roc_points_by_row(judged(spark, folder), "y", "score", ["event_id"]))


@query("roc_auc", f"{_CUM} SELECT {sql_rnd('sum(neg * (tp - pos / 2.0)) / (max(P) * max(N))')} AS auc, CAST(max(P) AS BIGINT) AS support FROM u")
def _(spark, folder):
    return rounded(curves.roc_auc(judged(spark, folder), "y", "score"))


@query("roc_auc_by_row", f"{_ROWS} SELECT {sql_rnd('sum((1 - y) * tp) / (max(P) * max(N))')} AS auc FROM u")
def _(spark, folder):
    return rounded(curves.roc_auc_by_row(judged(spark, folder), "y", "score", ["event_id"]))


_MULTI = f"""WITH d AS ({JUDGED}), x AS (SELECT unnest(['BENIGN', 'DoS Hulk', 'Heartbleed']) AS class, unnest([1 - score, score, confidence]) AS s, y_true FROM d),
  g AS (SELECT class, s, count(*) FILTER (y_true = class) AS pos, count(*) FILTER (y_true <> class) AS neg FROM x GROUP BY class, s),
  u AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY class ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N FROM g)"""


def _class_scores(spark, folder):
    return judged(spark, folder).withColumn("scores", F.create_map(
        F.lit("BENIGN"), F.lit(1) - col("score"), F.lit("DoS Hulk"), col("score"), F.lit("Heartbleed"), col("confidence")))


@query("multiclass_roc", f"""{_MULTI} SELECT class, {sql_rnd('s')} AS threshold, {sql_rnd('fp / N')} AS fpr, {sql_rnd('tp / P')} AS tpr FROM u
  UNION ALL SELECT DISTINCT class, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM u""")
def _(spark, folder):
    return rounded(curves.roc_points(curves.one_vs_rest(_class_scores(spark, folder), "y_true", "scores"), "y", "score", ["class"]))


@query("multiclass_auc", f"""{_MULTI}, a AS (SELECT class, sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)) AS auc, CAST(max(P) AS BIGINT) AS support FROM u GROUP BY class)
  SELECT class, {sql_rnd('auc')} AS auc, support, {sql_rnd('(SELECT sum(auc * support) / sum(support) FROM a)')} AS weighted_auc FROM a""")
def _(spark, folder):
    return rounded(curves.multiclass_auc(_class_scores(spark, folder), "y_true", "scores"))


_BEST = {
    "f1": "2 * tp / (2 * tp + fp + (P - tp))",
    "accuracy": "(tp + N - fp) / (P + N)",
    "youden": "tp / P - fp / N",
}
for _metric, _expression in _BEST.items():
    @query(f"best_threshold_{_metric}", f"{_CUM} SELECT round(threshold, 6) AS threshold, round(s, 6) AS score FROM (SELECT threshold, {_expression} AS s FROM u) v ORDER BY round(s, 12) DESC, threshold LIMIT 1")
    def _(spark, folder, metric=_metric):
        return rounded(curves.best_threshold(judged(spark, folder), "y", "score", metric))


def _grid_sql(thresholds, op):
    return f"""WITH d AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM ({JUDGED}) j GROUP BY score), t AS ({thresholds}),
    c AS (SELECT t, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp, (SELECT sum(pos) FROM d) AS P, (SELECT sum(neg) FROM d) AS N FROM t LEFT JOIN d ON score {op} t GROUP BY t),
    m AS (SELECT t AS threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, tp / P AS recall, (tp + N - fp) / (P + N) AS accuracy, CAST(tp + fp AS BIGINT) AS n_anomalies, (tp + fp) / (P + N) AS anomaly_rate,
                 CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + P) ELSE 0.0 END AS f1 FROM c)"""


_RATES = ", ".join(f"{sql_rnd(m)} AS {m}" for m in ("f1", "precision", "recall", "accuracy", "anomaly_rate"))
_GRID = "SELECT 0.0::DOUBLE + i * 0.001::DOUBLE AS t FROM range(1001) r(i)"


@query("threshold_grid", f"{_grid_sql(_GRID, '>')} SELECT round(threshold, 6) AS threshold, {_RATES}, n_anomalies FROM m")
def _(spark, folder):
    return rounded(curves.threshold_grid(judged(spark, folder), "y", "score")).drop("i")


@query("threshold_search", f"{_grid_sql(_GRID, '>')} SELECT round(threshold, 6) AS threshold, {_RATES}, n_anomalies, 'f1' AS optimization_metric, {sql_rnd('f1')} AS optimization_score FROM m ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def _(spark, folder):
    return rounded(curves.search_threshold(judged(spark, folder), "y", "score"))


@query("threshold_sensitivity", f"{_grid_sql('SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t', '>')} SELECT threshold, {_RATES}, n_anomalies FROM m")
def _(spark, folder):
    return rounded(curves.sensitivity(judged(spark, folder), "y", "score"))


@query("threshold_curve", f"""{_grid_sql('SELECT i * (1.0::DOUBLE / 199) AS t FROM range(200) r(i)', '>=')} SELECT {sql_rnd('threshold')} AS threshold, {', '.join(sql_rnd(m) + f' AS {m}' for m in ('precision', 'recall', 'f1'))},
  row_number() OVER (ORDER BY round(f1, 12) DESC, threshold) = 1 AS best FROM m""")
def _(spark, folder):
    return rounded(curves.threshold_curve(judged(spark, folder), "y", "score"))


@query("precision_recall", f"{_CUM} SELECT round(threshold, 6) AS threshold, {sql_rnd('tp / (tp + fp)')} AS precision, {sql_rnd('tp / P')} AS recall FROM u UNION ALL SELECT NULL, 1.0, 0.0")
def _(spark, folder):
    return rounded(curves.precision_recall(judged(spark, folder), "y", "score"))


@query("precision_recall_summary", f"""{_CUM}, v AS (SELECT threshold, tp / (tp + fp) AS p, tp / P AS r, lag(tp / (tp + fp), 1, 1.0) OVER (ORDER BY threshold DESC) AS p0, lag(tp / P, 1, 0.0) OVER (ORDER BY threshold DESC) AS r0 FROM u),
  f AS (SELECT threshold, 2 * p * r / (p + r + 1e-10) AS f1 FROM v ORDER BY round(2 * p * r / (p + r + 1e-10), 12) DESC, threshold LIMIT 1)
  SELECT {sql_rnd('(SELECT sum((r - r0) * (p + p0) / 2) FROM v)')} AS pr_auc, round(threshold, 6) AS threshold, {sql_rnd('f1')} AS f1 FROM f""")
def _(spark, folder):
    return rounded(curves.precision_recall_summary(judged(spark, folder), "y", "score"))


@query("backtest_windows", f"""
  WITH d AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS window_id FROM ({_FLAG}) f)
  SELECT window_id, count(*) AS samples, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {_TN} AS tn, {sql_rnd(f'({_TP} + {_TN}) / count(*)::DOUBLE')} AS accuracy FROM d GROUP BY window_id""")
def _(spark, folder):
    return rounded(curves.backtest(_flagged(spark, folder), ["event_id"], "y", "flag"))


@query("scores_normalised", f"""SELECT event_id, {sql_rnd('1.0 - (score - lo) / (hi - lo)')} AS anomaly_score FROM ({JUDGED}) d, (SELECT min(score) AS lo, max(score) AS hi FROM ({JUDGED}) e) x""")
def _(spark, folder):
    from ..operators.forest import normalise
    return rounded(normalise(judged(spark, folder).select("event_id", "score"), "score")).drop("score")


@query("scores_normalised_per_batch", f"""SELECT event_id, {sql_rnd('CASE WHEN hi > lo THEN 1.0 - (score - lo) / (hi - lo) ELSE 0.0 END')} AS anomaly_score FROM
  (SELECT event_id, score, min(score) OVER (PARTITION BY event_id // 100) AS lo, max(score) OVER (PARTITION BY event_id // 100) AS hi FROM ({JUDGED}) d) x""")
def _(spark, folder):
    from ..operators.forest import normalise
    d = judged(spark, folder).select("event_id", "score", F.expr("event_id div 100").alias("batch_id"))
    return rounded(normalise(d, "score", ["batch_id"])).select("event_id", "anomaly_score")
