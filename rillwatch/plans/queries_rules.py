"""Queries over severity, decision, alert and response rules, and over the statistics of detections and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import col
from ..functions import rules
from ..operators import metrics, opstats
from .inputs import DETECTIONS, OPERATIONS, detections, operations, table
from .registry import query, rnd, rounded, sql_rnd

_LEVEL = "CASE WHEN {s} >= 0.9 THEN 'critical' WHEN {s} >= 0.7 THEN 'high' WHEN {s} >= 0.5 THEN 'medium' ELSE 'low' END"


@query("sigmoid_scores", f"SELECT event_id, {sql_rnd('1.0 / (1.0 + exp(least(greatest((value - 50) * 20, -500.0), 500.0)))', 9)} AS score FROM events")
def _(spark, folder):
    e = table(spark, folder, "events")
    return e.select("event_id", rnd(rules.sigmoid_score((col("value") - 50) * 20), 9).alias("score"))


@query("severity_rules", f"""
  SELECT event_id,
    CASE WHEN anomaly_score >= 0.9 OR (is_zero_day AND classification_confidence >= 0.7) THEN 'critical' ELSE {_LEVEL.format(s='anomaly_score')} END AS plain,
    {_LEVEL.format(s='boosted')} AS boosted,
    CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high' WHEN anomaly_score >= 0.5 THEN 'medium' ELSE 'low' END AS configured,
    CASE WHEN NOT is_zero_day THEN severity WHEN severity = 'low' THEN 'medium' WHEN severity = 'medium' THEN 'high' ELSE 'critical' END AS raised
  FROM (SELECT *, CASE WHEN is_zero_day THEN round(least(1.0, anomaly_score + 0.2), 10) ELSE anomaly_score END AS boosted FROM ({DETECTIONS}) d) b""")
def _(spark, folder):
    s, z = col("anomaly_score"), col("is_zero_day")
    return detections(spark, folder).select(
        "event_id", rules.severity_plain(s, col("classification_confidence"), z).alias("plain"),
        rules.severity_boosted(s, z).alias("boosted"), rules.severity_configured(s).alias("configured"),
        rules.severity_raised(col("severity"), z).alias("raised"))


@query("decisions", """
  SELECT event_id, CASE WHEN NOT a THEN 'BENIGN' WHEN l IS NULL THEN 'UNKNOWN' WHEN l = 'BENIGN' OR c < 0.5 THEN 'ZERO_DAY' ELSE l END AS predicted_class,
         CASE WHEN NOT a THEN 1.0 WHEN l IS NULL THEN 0.0 ELSE c END AS confidence,
         a AND (l IS NULL OR l = 'BENIGN' OR c < 0.5) AS is_zero_day,
         CASE WHEN NOT a THEN 'not_anomalous' WHEN l IS NULL THEN 'anomaly_no_classifier' WHEN l = 'BENIGN' THEN 'anomaly_classified_as_benign'
              WHEN c < 0.5 THEN 'low_classification_confidence' ELSE 'known_attack' END AS reason
  FROM (SELECT event_id, is_anomaly AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE raw_class END AS l, classification_confidence AS c FROM (""" + DETECTIONS + ") d) x")
def _(spark, folder):
    d = detections(spark, folder).withColumn("label", F.when(col("event_id") % 11 != 0, col("raw_class")))
    made = rules.decision(col("is_anomaly"), col("label"), col("classification_confidence"))
    return d.select("event_id", made.alias("d")).select("event_id", "d.predicted_class", "d.confidence", "d.is_zero_day", "d.reason")


@query("threshold_confidence", f"SELECT event_id, {sql_rnd('least(abs(anomaly_score - 0.3) / 0.3, 1.0)')} AS confidence FROM ({DETECTIONS}) d")
def _(spark, folder):
    return detections(spark, folder).select("event_id", rnd(rules.threshold_confidence(col("anomaly_score"), 0.3)).alias("confidence"))


@query("low_confidence_flags", f"""SELECT event_id, classification_confidence AS confidence, raw_class AS predicted_label, classification_confidence < 0.5 AS low_confidence,
  CASE WHEN classification_confidence < 0.5 THEN raw_class END AS original_label FROM ({DETECTIONS}) d""")
def _(spark, folder):
    d = detections(spark, folder).select("event_id", col("classification_confidence").alias("confidence"), col("raw_class").alias("predicted_label"))
    return rules.confidence_filter(d)


_MESSAGE = """CASE WHEN is_zero_day THEN format('ZERO-DAY THREAT DETECTED: Anomalous traffic (score={:.4f}) not matching any known attack class. Severity: {}', anomaly_score, upper(severity))
    ELSE format('DoS ATTACK DETECTED: {} (anomaly_score={:.4f}, confidence={:.4f}). Severity: {}', predicted_class, anomaly_score, classification_confidence, upper(severity)) END"""
# Scores on a grid of 1/1024: four digits of a text are then the same however a tie is rounded.
_COARSE = f"SELECT * REPLACE ((floor(anomaly_score * 50)) / 50 + 0.0025 AS anomaly_score) FROM ({DETECTIONS}) d"
_ALERTS = f"""SELECT 'alert_' || sample_id || '_' || CAST(floor(anomaly_score * 10000) AS BIGINT) AS alert_id, sample_id, severity, predicted_class, anomaly_score,
    classification_confidence, is_zero_day, {_MESSAGE} AS message FROM ({_COARSE}) c WHERE is_anomaly"""


def _coarse(spark, folder):
    return detections(spark, folder).withColumn("anomaly_score", F.floor(col("anomaly_score") * 50) / 50 + F.lit(0.0025))


@query("alert_rows", _ALERTS)
def _(spark, folder):
    return rules.alert_rows(_coarse(spark, folder))


_GENERATED = f"""SELECT sample_id, ts AS timestamp,
    CASE WHEN NOT is_zero_day THEN severity WHEN severity = 'low' THEN 'medium' WHEN severity = 'medium' THEN 'high' ELSE 'critical' END AS severity,
    predicted_class, anomaly_score, classification_confidence, is_zero_day, {_MESSAGE} AS message, detection_latency_ms
    FROM ({_COARSE}) c WHERE is_anomaly AND (is_zero_day OR classification_confidence >= 0.5)"""


def generated(spark, folder):
    return rules.generated_alerts(_coarse(spark, folder))


@query("generated_alerts", _GENERATED)
def _(spark, folder):
    return generated(spark, folder).select("*", "details.detection_latency_ms").drop("alert_id", "details")


@query("alerts_as_text", f"""
  SELECT alert_id, CASE severity WHEN 'critical' THEN '[!!!]' WHEN 'high' THEN '[!! ]' WHEN 'medium' THEN '[!  ]' ELSE '[   ]' END || ' [' || upper(severity) || '] Alert: ' || alert_id
    || chr(10) || '  Time:      2024-02-01 00:00:00' || chr(10) || '  Class:     ' || predicted_class || chr(10) || '  Score:     ' || format('{{:.4f}}', anomaly_score)
    || chr(10) || '  Confidence:' || format('{{:.4f}}', classification_confidence) || chr(10) || '  Zero-Day:  ' || CASE WHEN is_zero_day THEN 'YES' ELSE 'no' END
    || chr(10) || '  Message:   ' || message AS line FROM ({_ALERTS}) a""")
def _(spark, folder):
    return rules.formatted_alerts(rules.alert_rows(_coarse(spark, folder)), "text", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("alerts_as_csv", f"""
  SELECT alert_id, concat_ws(',', alert_id, sample_id, severity, predicted_class, CAST(anomaly_score AS VARCHAR), CAST(classification_confidence AS VARCHAR),
    CASE WHEN is_zero_day THEN 'True' ELSE 'False' END, CASE WHEN regexp_matches(message, '[,"]') THEN '"' || replace(message, '"', '""') || '"' ELSE message END) AS line
  FROM ({_ALERTS}) a""")
def _(spark, folder):
    return rules.formatted_alerts(rules.alert_rows(_coarse(spark, folder)), "csv", F.lit(None))


@query("alerts_as_json", f"""SELECT alert_id, severity, predicted_class, anomaly_score, is_zero_day, message, '2024-02-01' AS formatted_at FROM ({_ALERTS}) a""")
def _(spark, folder):
    lines = rules.formatted_alerts(rules.alert_rows(_coarse(spark, folder)), "json", F.lit("2024-02-01"))
    schema = "severity string, predicted_class string, anomaly_score double, is_zero_day boolean, message string, formatted_at string"
    return lines.select("alert_id", F.from_json("line", schema).alias("j")).select("alert_id", "j.*")


@query("flat_detections", f"SELECT sample_id, is_anomaly, anomaly_score, predicted_class, classification_confidence, severity, is_zero_day, detection_latency_ms FROM ({DETECTIONS}) d")
def _(spark, folder):
    return rules.flat_detections(detections(spark, folder))


_MODEL_SCORES = """SELECT event_id, k / 100.0 AS a, (100 - k) / 200.0 AS b, (100 - k) / 400.0 AS c FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e"""


def model_scores(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, folder, "events").select("event_id", (k / 100.0).alias("a"), ((F.lit(100) - k) / 200.0).alias("b"),
                                              ((F.lit(100) - k) / 400.0).alias("c"))
    return e.select("event_id", F.create_map(F.lit("BENIGN"), col("a"), F.lit("DoS Hulk"), col("b"), F.lit("Heartbleed"), col("c")).alias("probabilities"))


@query("flat_probabilities", f"SELECT event_id, a AS \"prob_BENIGN\", b AS \"prob_DoS Hulk\", c AS \"prob_Heartbleed\" FROM ({_MODEL_SCORES}) m")
def _(spark, folder):
    return rules.flat_probabilities(model_scores(spark, folder), "probabilities", ["BENIGN", "DoS Hulk", "Heartbleed"])


@query("top_predictions", f"""
  SELECT event_id, rank, label, probability FROM (
    SELECT event_id, label, probability, CAST(row_number() OVER (PARTITION BY event_id ORDER BY probability DESC, label DESC) AS INTEGER) - 1 AS rank
    FROM (SELECT event_id, unnest(['BENIGN', 'DoS Hulk', 'Heartbleed']) AS label, unnest([a, b, c]) AS probability FROM ({_MODEL_SCORES}) m) x) y WHERE rank < 2""")
def _(spark, folder):
    m = model_scores(spark, folder)
    top = rules.top_predictions(F.map_keys("probabilities"), F.map_values("probabilities"), 2)
    return m.select("event_id", F.posexplode(top).alias("rank", "t")).select("event_id", "rank", "t.label", "t.probability")


@query("response_actions", f"""
  WITH d AS ({DETECTIONS}), h AS (SELECT * FROM d WHERE is_anomaly OR is_zero_day)
  SELECT event_id, 0 AS step, 'log' AS action_type, sample_id AS target, 'Log ' || severity || ' severity detection' AS description FROM h
  UNION ALL SELECT event_id, 1, 'alert', sample_id, 'Alert for ' || severity || ' severity detection' FROM h WHERE severity IN ('critical', 'high')
  UNION ALL SELECT event_id, 2, 'quarantine', sample_id, 'Quarantine zero-day detection' FROM h WHERE is_zero_day
  UNION ALL SELECT event_id, 3, 'block', sample_id, 'Block critical severity source' FROM h WHERE severity = 'critical'""")
def _(spark, folder):
    return rules.response_actions(detections(spark, folder), True, True, True).select("event_id", "step", "action_type", "target", "description")


@query("normalised_records", f"""SELECT NULL::TIMESTAMP AS timestamp, is_anomaly, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE anomaly_score END, 0.0) AS anomaly_score,
   predicted_class, 0.0::DOUBLE AS classification_confidence, is_zero_day, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE severity END, 'low') AS severity, 0.0::DOUBLE AS latency_ms FROM ({DETECTIONS}) d""")
def _(spark, folder):
    d = detections(spark, folder).select("is_anomaly", F.when(col("event_id") % 7 != 0, col("anomaly_score")).alias("anomaly_score"),
                                         "predicted_class", "is_zero_day", F.when(col("event_id") % 5 != 0, col("severity")).alias("severity"))
    return rules.normalised_detections(d)


@query("parsed_times", """
  SELECT event_id, ts AS from_text, date_trunc('second', ts) AS from_format, make_timestamp((event_id * 60) * 1000000) AS from_epoch, epoch_us(ts) // 1000 AS ms FROM events""")
def _(spark, folder):
    e = table(spark, folder, "events")
    ntz = lambda c: c.cast("timestamp_ntz")
    return e.select("event_id", ntz(rules.parse_time(col("ts").cast("string"))).alias("from_text"),
                    ntz(rules.parse_time(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "dd/MM/yyyy HH:mm:ss")).alias("from_format"),
                    ntz(rules.parse_time(col("event_id") * 60, epoch=True)).alias("from_epoch"), rules.to_unix_ms(col("ts")).alias("ms"))


@query("durations_as_text", """
  SELECT event_id, CASE WHEN s < 1e-6 THEN printf('%.2f ns', s * 1e9) WHEN s < 1e-3 THEN printf('%.2f us', s * 1e6) WHEN s < 1 THEN printf('%.2f ms', s * 1e3)
    WHEN s >= 3600 THEN printf('%dh %dm %ds', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60, CAST(floor(s) AS BIGINT) % 60)
    WHEN s >= 60 THEN printf('%dm %ds', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60) ELSE printf('%.2fs', s) END AS text
  FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2.5e-7 * (1 + event_id % 3) WHEN 1 THEN 0.000125 * (event_id % 8) WHEN 2 THEN 0.0625 * (event_id % 16) WHEN 3 THEN event_id % 60 ELSE event_id END AS s FROM events) x""")
def _(spark, folder):
    s = F.expr("CASE event_id % 5 WHEN 0 THEN 2.5e-7D * (1 + event_id % 3) WHEN 1 THEN 0.000125D * (event_id % 8) WHEN 2 THEN 0.0625D * (event_id % 16) WHEN 3 THEN event_id % 60 ELSE event_id END")
    return table(spark, folder, "events").select("event_id", s.cast("double").alias("s")).select("event_id", rules.format_duration(col("s")).alias("text"))


# --- statistics -----------------------------------------------------------------------------------------------------

@query("detection_totals", f"""
  SELECT count(*) AS total_samples, count(*) FILTER (is_anomaly) AS anomalies_detected, count(*) FILTER (NOT is_anomaly) AS normal_samples,
    count(*) FILTER (is_zero_day) AS zero_day_detected, {sql_rnd('avg(is_anomaly::INT)')} AS anomaly_rate, {sql_rnd('avg(anomaly_score)')} AS mean_anomaly_score,
    {sql_rnd('avg(classification_confidence)')} AS mean_classification_confidence, {sql_rnd('avg(detection_latency_ms)')} AS mean_latency_ms FROM ({DETECTIONS}) d""")
def _(spark, folder):
    return rounded(opstats.detection_totals(detections(spark, folder)))


_BREAKDOWN = """
  SELECT 'total' AS breakdown, '' AS key, count(*) AS n, count(*) FILTER (is_zero_day) AS zero_days FROM a
  UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (is_zero_day) FROM a GROUP BY severity
  UNION ALL SELECT 'class', predicted_class, count(*), count(*) FILTER (is_zero_day) FROM a GROUP BY predicted_class"""


@query("alert_summary", f"WITH a AS ({_GENERATED}) {_BREAKDOWN}")
def _(spark, folder):
    return opstats.breakdown(generated(spark, folder))


@query("detection_breakdown", f"WITH a AS ({DETECTIONS}) {_BREAKDOWN}")
def _(spark, folder):
    return opstats.breakdown(detections(spark, folder))


@query("history_metrics", f"""
  SELECT date_trunc('day', ts) AS day, count(*) AS total_detections, {sql_rnd('avg(is_anomaly::INT)')} AS anomaly_rate, {sql_rnd('avg(is_zero_day::INT)')} AS zero_day_rate,
         {sql_rnd('avg(anomaly_score)')} AS avg_anomaly_score, {sql_rnd('avg(detection_latency_ms)')} AS avg_latency_ms FROM ({DETECTIONS}) d GROUP BY 1""")
def _(spark, folder):
    d = detections(spark, folder).withColumns({"day": F.date_trunc("day", "ts").cast("timestamp_ntz"), "latency_ms": col("detection_latency_ms")})
    return rounded(opstats.history_metrics(d, ["day"]))


@query("batch_summary", f"""
  WITH b AS (SELECT batch_id, count(*) AS total_samples, count(*) FILTER (is_anomaly OR is_zero_day) AS total_alerts, count(*) FILTER (is_anomaly) AS anomaly_count,
                    count(*) FILTER (is_zero_day) AS zero_day_count FROM ({DETECTIONS}) d GROUP BY batch_id)
  SELECT *, CAST(sum(total_samples) OVER w AS BIGINT) AS processed_count, CAST(sum(total_alerts) OVER w AS BIGINT) AS alert_count,
         round(sum(total_alerts) OVER w / (sum(total_samples) OVER w)::DOUBLE, 4) AS alert_rate FROM b WINDOW w AS (ORDER BY batch_id)""")
def _(spark, folder):
    return opstats.batch_summary(detections(spark, folder))


@query("threat_levels", f"""
  SELECT batch_id, round(r, 6) AS rate_percent, CASE WHEN r > 10 THEN 'critical' WHEN r > 5 THEN 'high' WHEN r > 1 THEN 'medium' ELSE 'low' END AS threat
  FROM (SELECT batch_id, avg((is_anomaly AND event_id % 5 = 0)::INT) * 100 AS r FROM ({DETECTIONS}) d GROUP BY batch_id) x""")
def _(spark, folder):
    d = detections(spark, folder).withColumn("is_anomaly", col("is_anomaly") & (col("event_id") % 5 == 0))
    return rounded(opstats.threat_levels(d, "batch_id"))


@query("severity_counts", f"""SELECT CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS position, severity, count(*) AS n FROM ({DETECTIONS}) d GROUP BY severity""")
def _(spark, folder):
    return opstats.severity_counts(detections(spark, folder))


@query("hourly_counts", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, folder):
    return opstats.hourly_counts(table(spark, folder, "events"))


@query("zero_day_timeline", f"SELECT ts AS timestamp, anomaly_score, severity, is_zero_day FROM ({DETECTIONS}) d WHERE is_zero_day")
def _(spark, folder):
    return opstats.alert_timeline(detections(spark, folder), zero_day_only=True)


@query("alert_timeline", f"SELECT ts AS timestamp, anomaly_score, severity, is_zero_day FROM ({DETECTIONS}) d WHERE is_anomaly")
def _(spark, folder):
    return opstats.alert_timeline(detections(spark, folder).filter("is_anomaly"))


@query("score_series", f"SELECT ts AS timestamp, anomaly_score AS value FROM ({DETECTIONS}) d")
def _(spark, folder):
    return opstats.series(detections(spark, folder), "ts", "anomaly_score")


@query("class_values", "SELECT event_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE * 100, 2) AS percentage FROM events GROUP BY 1")
def _(spark, folder):
    from ..operators.profile import class_distribution
    return class_distribution(table(spark, folder, "events"), "event_type").select("label", "n", "percentage")


@query("score_histogram", f"""
  WITH d AS ({DETECTIONS}), e AS (SELECT is_anomaly, min(anomaly_score) AS lo, max(anomaly_score) AS hi, count(*) AS n FROM d GROUP BY 1)
  SELECT is_anomaly, CAST(least(floor((anomaly_score - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin,
         {sql_rnd('any_value(lo + (hi - lo) / 50 * least(floor((anomaly_score - lo) / ((hi - lo) / 50)), 49))')} AS "left", count(*) AS n,
         {sql_rnd('count(*) / any_value(e.n * ((hi - lo) / 50))')} AS density FROM d JOIN e USING (is_anomaly) GROUP BY 1, 2""")
def _(spark, folder):
    return rounded(opstats.score_histogram(detections(spark, folder), "anomaly_score", "is_anomaly"))


_LATENCY = ", ".join([f"{sql_rnd('avg(duration_ms)', 5)} AS mean_ms", f"{sql_rnd('stddev_pop(duration_ms)', 5)} AS std_ms", "min(duration_ms) AS min_ms",
                      "max(duration_ms) AS max_ms", *[f"{sql_rnd(f'quantile_cont(duration_ms, 0.{p})', 5)} AS p{p}_ms" for p in (50, 95, 99)],
                      f"{sql_rnd('sum(duration_ms)', 4)} AS total_ms"])


# The operation log with some operations unnamed.
_UNNAMED = f"SELECT * REPLACE (CASE WHEN event_id % 11 = 3 THEN NULL ELSE operation END AS operation) FROM ({OPERATIONS}) o"


def unnamed(spark, folder):
    return operations(spark, folder).withColumn("operation", F.when(F.col("event_id") % 11 != 3, F.col("operation")))


@query("latency_statistics", f"SELECT operation, GROUPING(operation) = 1 AS overall, count(*) AS count, {_LATENCY} FROM ({_UNNAMED}) o GROUP BY ROLLUP (operation)")
def _(spark, folder):
    s = opstats.latency_statistics(unnamed(spark, folder))
    return rounded(s.withColumn("total_ms", rnd("total_ms", 4)), 5)


@query("throughput_statistics", f"""
  SELECT operation, count(*) AS measurements, CAST(sum(samples) AS BIGINT) AS total_samples, {sql_rnd('sum(elapsed_s)', 5)} AS total_time_s, {sql_rnd('avg(rate)', 3)} AS mean_rate,
    {sql_rnd('stddev_pop(rate)', 3)} AS std_rate, {sql_rnd('min(rate)', 5)} AS min_rate, {sql_rnd('max(rate)', 5)} AS max_rate, {sql_rnd('sum(samples) / sum(elapsed_s)', 5)} AS avg_rate
  FROM (SELECT *, CASE WHEN elapsed_s > 0 THEN samples / elapsed_s ELSE 0.0 END AS rate FROM ({OPERATIONS}) o) r GROUP BY operation""")
def _(spark, folder):
    s = opstats.throughput_statistics(operations(spark, folder))
    return rounded(s.withColumns({"mean_rate": rnd("mean_rate", 3), "std_rate": rnd("std_rate", 3)}), 5)


_SORTED = f"WITH s AS (SELECT duration_ms AS d, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM ({OPERATIONS}) o)"


@query("floor_latency", f"""{_SORTED} SELECT {sql_rnd('avg(d)')} AS avg_latency_ms, min(d) AS min_latency_ms, max(d) AS max_latency_ms, count(*) AS total_measurements,
  {', '.join(f'max(d) FILTER (i = floor(n * 0.{p}::DOUBLE)) AS p{p}_latency_ms' for p in (50, 95, 99))} FROM s""")
def _(spark, folder):
    return rounded(opstats.floor_latency(operations(spark, folder)))


@query("box_statistics", f"""{_SORTED} SELECT min(d) AS min, max(d) FILTER (i = n // 4) AS q1, max(d) FILTER (i = n // 2) AS median, max(d) FILTER (i = 3 * n // 4) AS q3,
  max(d) AS max, {sql_rnd('avg(d)')} AS mean FROM s""")
def _(spark, folder):
    return rounded(opstats.box_statistics(operations(spark, folder), "duration_ms"))


_BATCH_LOG = f"SELECT batch_id, count(*) AS size, min(duration_ms) AS queue_ms, sum(duration_ms) AS processing_ms FROM ({OPERATIONS}) o GROUP BY batch_id"


@query("batch_statistics", f"""
  SELECT count(*) AS batches, CAST(sum(size) AS BIGINT) AS total_samples, {sql_rnd('avg(size)')} AS avg_batch_size, {sql_rnd('avg(queue_ms)')} AS avg_queue_time_ms,
    {sql_rnd('avg(processing_ms)', 4)} AS avg_processing_time_ms, {sql_rnd('quantile_cont(queue_ms, 0.95)')} AS p95_queue_time_ms,
    {sql_rnd('quantile_cont(processing_ms, 0.95)', 4)} AS p95_processing_time_ms FROM ({_BATCH_LOG}) b""")
def _(spark, folder):
    b = operations(spark, folder).groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"), F.min("duration_ms").alias("queue_ms"),
                                                          F.sum("duration_ms").alias("processing_ms"))
    s = opstats.batch_statistics(b)
    return rounded(s.withColumns({c: rnd(c, 4) for c in ("avg_processing_time_ms", "p95_processing_time_ms")}))


@query("handler_statistics", f"""SELECT handler, count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
  {sql_rnd('avg(success::INT)')} AS success_rate FROM ({OPERATIONS}) o GROUP BY handler""")
def _(spark, folder):
    return rounded(opstats.handler_statistics(operations(spark, folder)))


@query("action_statistics", f"""SELECT operation AS action_type, GROUPING(operation) = 1 AS overall, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed
  FROM ({_UNNAMED}) o GROUP BY ROLLUP (operation)""")
def _(spark, folder):
    return opstats.action_statistics(unnamed(spark, folder).withColumnRenamed("operation", "action_type"))


@query("last_actions", "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC LIMIT 25")
def _(spark, folder):
    return opstats.last_actions(table(spark, folder, "events").select("event_id", "event_type", "ts"), 25, ["ts", "event_id"])


@query("stream_batches", """
  SELECT event_id, rn AS position, rn // 32 AS batch_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events) x WHERE rn < 5000""")
def _(spark, folder):
    return opstats.with_batches(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"], 32, 5000).drop("ts")


@query("stream_batches_all", """
  SELECT event_id, rn AS position, rn // 32 AS batch_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events) x""")
def _(spark, folder):
    return opstats.with_batches(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"], 32).drop("ts")


@query("row_range", "SELECT event_id, rn AS position FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rn FROM events) x WHERE rn >= 200 AND rn < 321")
def _(spark, folder):
    return opstats.row_range(table(spark, folder, "events").select("event_id", "value"), ["value", "event_id"], 200, 321).drop("value")


@query("sliding_windows", """
  WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events),
       w AS (SELECT s AS window_start, least(s + 500, n) AS window_end FROM (SELECT count(*) AS n FROM events), unnest(range(0, n, 300)) t(s) WHERE s = 0 OR s - 300 + 500 < n)
  SELECT event_id, position, window_start, window_end FROM p JOIN w ON position >= window_start AND position < window_end""")
def _(spark, folder):
    return opstats.sliding_windows(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"], 500, 300).drop("ts")


@query("alert_table", f"""SELECT CAST(ts AS VARCHAR) AS timestamp, severity, predicted_class, round(anomaly_score, 4) AS anomaly_score, is_zero_day FROM ({_COARSE}) c WHERE is_anomaly""")
def _(spark, folder):
    a = _coarse(spark, folder).filter("is_anomaly").withColumnRenamed("ts", "timestamp")
    return metrics.alert_table(a)
