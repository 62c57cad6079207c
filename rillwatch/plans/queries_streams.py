"""Queries over sinks, suppression and streams. A stream runs over everything available and its table is read back."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from ..core import col, work_path
from ..functions import rules
from ..operators import limits, metrics
from ..sources import alert_store
from ..streaming import carried, flushing, jobs, model_store, readers, row_files, stateful
from .inputs import DETECTIONS, JUDGED, detections, from_events, judged, table
from .queries_models import _UNIT, _detector, _events, models
from .registry import ORACLE, query, rounded, sql_rnd

_SQL_ALERTS = f"SELECT ts AS timestamp, 'a' || event_id AS alert_id, severity, predicted_class, anomaly_score, classification_confidence, is_zero_day, sample_id, 'm' AS message FROM ({DETECTIONS}) d WHERE is_anomaly"


def _alerts(spark, folder):
    return detections(spark, folder).filter("is_anomaly").select(
        col("ts").alias("timestamp"), F.concat(F.lit("a"), col("event_id").cast("string")).alias("alert_id"), "severity", "predicted_class",
        "anomaly_score", "classification_confidence", "is_zero_day", "sample_id", F.lit("m").alias("message"))


# --- alert tables ---------------------------------------------------------------------------------------------------

@query("alerts_json_table", f"SELECT *, CAST(timestamp AS DATE) AS alert_date FROM ({_SQL_ALERTS}) a")
def _(spark, folder):
    path = work_path(spark, "alerts")
    alert_store.write_json(_alerts(spark, folder), path)
    return alert_store.read_alerts(spark, path)


@query("alerts_csv_table", f"SELECT * FROM ({_SQL_ALERTS}) a")
def _(spark, folder):
    path = work_path(spark, "alerts")
    alert_store.write_csv(_alerts(spark, folder), path)
    return alert_store.read_alerts(spark, path, "csv").drop("alert_date")


@query("alerts_in_both_formats", f"SELECT fmt, count(*) AS n, count(DISTINCT alert_id) AS ids FROM ({_SQL_ALERTS}) a, (SELECT unnest(['json', 'csv']) AS fmt) f GROUP BY fmt")
def _(spark, folder):
    path = work_path(spark, "alerts")
    alert_store.write_alerts(_alerts(spark, folder), path, "both")
    counted = [alert_store.read_alerts(spark, f"{path}/{f}", f).agg(F.lit(f).alias("fmt"), F.count(F.lit(1)).alias("n"), F.countDistinct("alert_id").alias("ids"))
               for f in ("json", "csv")]
    return counted[0].unionAll(counted[1])


@query("alert_csv_columns", f"SELECT CAST(timestamp AS VARCHAR) AS timestamp, alert_id, severity, '' AS predicted_class, CAST(anomaly_score AS VARCHAR) AS anomaly_score, CAST(classification_confidence AS VARCHAR) AS classification_confidence, CAST(is_zero_day AS VARCHAR) AS is_zero_day, sample_id, message FROM ({_SQL_ALERTS}) a")
def _(spark, folder):
    return alert_store.csv_columns(_alerts(spark, folder).drop("predicted_class"))


@query("alerts_of_newest_days", f"SELECT alert_id, CAST(timestamp AS DATE) AS alert_date FROM ({_SQL_ALERTS}) a WHERE CAST(timestamp AS DATE) IN (SELECT DISTINCT CAST(timestamp AS DATE) AS d FROM ({_SQL_ALERTS}) b ORDER BY d DESC LIMIT 10)")
def _(spark, folder):
    path = work_path(spark, "alerts")
    alert_store.write_json(_alerts(spark, folder), path)
    return alert_store.newest_days(alert_store.read_alerts(spark, path), 10).select("alert_id", "alert_date")


@query("alerts_archived", f"SELECT place, count(*) AS n, count(DISTINCT alert_id) AS ids, min(CAST(timestamp AS DATE)) AS first_day FROM (SELECT *, CASE WHEN timestamp < '2024-01-15' THEN 'archive' ELSE 'current' END AS place FROM ({_SQL_ALERTS}) a) p GROUP BY place")
def _(spark, folder):
    path, old = work_path(spark, "alerts"), work_path(spark, "archive")
    for run in (0, 1):  # as a stream writes them: a folder per run and day
        alert_store.write_alerts(_alerts(spark, folder).filter(F.pmod(F.xxhash64("alert_id"), F.lit(2)) == run), path, mode="overwrite", run=run)
    for _ in range(2):
        alert_store.archive(spark, f"{path}/json", old, date(2024, 1, 15))
    part = lambda name, p: alert_store.read_alerts(spark, p).agg(
        F.lit(name).alias("place"), F.count(F.lit(1)).alias("n"), F.countDistinct("alert_id").alias("ids"), F.min("alert_date").alias("first_day"))
    return part("archive", old).unionAll(part("current", f"{path}/json"))


@query("alerts_dispatched", f"SELECT alert_id, sample_id, '2024-02-01' AS dispatched_at, (SELECT count(*) FROM ({_SQL_ALERTS}) b) AS dispatched FROM ({_SQL_ALERTS}) a")
def _(spark, folder):
    path = work_path(spark, "dispatched")
    n = alert_store.dispatch(_alerts(spark, folder), path, F.lit("2024-02-01"))
    sent = alert_store.read_alerts(spark, path, schema="alert_id string, sample_id string, dispatched_at string")
    return sent.select("alert_id", "sample_id", "dispatched_at", F.lit(n).cast("bigint").alias("dispatched"))


@query("report_saved", f"SELECT 'run' AS report_name, {sql_rnd('avg((y_true = y_pred)::INT)')} AS accuracy, count(*) AS total_samples FROM ({JUDGED}) d")
def _(spark, folder):
    path = work_path(spark, "report")
    alert_store.save_report(metrics.evaluation_report(judged(spark, folder), "run"), path)
    schema = "report_name string, summary struct<accuracy double, total_samples bigint>"
    return rounded(spark.read.schema(schema).json(path).select("report_name", "summary.accuracy", "summary.total_samples"))


# --- suppression ----------------------------------------------------------------------------------------------------

# Some rows have no source; together they are one.
_COOL = f"""
  WITH RECURSIVE d AS MATERIALIZED (SELECT *, coalesce(sample_id, '-') AS s FROM (
           SELECT event_id, ts, CASE WHEN event_id % 13 <> 5 THEN sample_id END AS sample_id FROM ({DETECTIONS}) x WHERE is_anomaly) y),
  first_rows AS (SELECT s, min(ts) AS ts FROM d GROUP BY s),
  kept AS (SELECT s, ts FROM first_rows
           UNION ALL SELECT k.s, (SELECT min(d.ts) FROM d WHERE d.s = k.s AND d.ts >= k.ts + INTERVAL 86400 SECOND) FROM kept k
           WHERE (SELECT min(d.ts) FROM d WHERE d.s = k.s AND d.ts >= k.ts + INTERVAL 86400 SECOND) IS NOT NULL),
  cooled AS (SELECT d.event_id, d.ts, d.sample_id FROM d JOIN kept USING (s, ts))"""


def _sourced(spark, folder):
    return _hits(spark, folder).withColumn("sample_id", F.when(col("event_id") % 13 != 5, col("sample_id")))


def _hits(spark, folder):
    return detections(spark, folder).filter("is_anomaly").select("event_id", "ts", "sample_id")


@query("cool_down", f"{_COOL} SELECT * FROM cooled")
def _(spark, folder):
    return limits.cool_down(_sourced(spark, folder), "sample_id", "ts", "event_id", 86400, slice_seconds=172800)


_TOP = "SELECT event_id, ts, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM {source}) y WHERE r <= 4"


@query("alerts_per_minute", _TOP.format(source=f"(SELECT * FROM ({DETECTIONS}) x WHERE is_anomaly) z"))
def _(spark, folder):
    return limits.per_minute_limit(_hits(spark, folder), "ts", "event_id", 4, 3600)


@query("cool_down_then_limit", f"{_COOL}, lim AS ({_TOP.replace('hour', 'day').format(source='cooled')}) SELECT * FROM lim")
def _(spark, folder):
    cooled = limits.cool_down(_sourced(spark, folder), "sample_id", "ts", "event_id", 86400)
    return limits.per_minute_limit(cooled, "ts", "event_id", 4, 86400)


@query("alerts_per_anchored_minute", f"""
  WITH RECURSIVE d AS MATERIALIZED (SELECT event_id, ts, sample_id FROM ({DETECTIONS}) x WHERE is_anomaly),
  starts AS (SELECT min(ts) AS s FROM d UNION ALL SELECT (SELECT min(ts) FROM d WHERE ts > s + INTERVAL 1 HOUR) FROM starts WHERE (SELECT min(ts) FROM d WHERE ts > s + INTERVAL 1 HOUR) IS NOT NULL),
  named AS (SELECT event_id, ts, sample_id, s FROM d ASOF JOIN starts ON d.ts >= starts.s)
  SELECT event_id, ts, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, event_id) AS r FROM named) y WHERE r <= 4""")
def _(spark, folder):
    return limits.anchored_minute_limit(_hits(spark, folder), "ts", "event_id", 4, 3600)


@query("alerts_limited", f"""{_COOL},
  c AS MATERIALIZED (SELECT * FROM cooled),
  starts AS (SELECT min(ts) AS t0 FROM c UNION ALL SELECT (SELECT min(ts) FROM c WHERE ts > t0 + INTERVAL 1 HOUR) FROM starts WHERE (SELECT min(ts) FROM c WHERE ts > t0 + INTERVAL 1 HOUR) IS NOT NULL),
  named AS (SELECT event_id, ts, sample_id, t0 FROM c ASOF JOIN starts ON c.ts >= starts.t0)
  SELECT event_id, ts, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY t0 ORDER BY ts, event_id) AS r FROM named) y WHERE r <= 4""")
def _(spark, folder):
    return limits.alert_limits(_sourced(spark, folder), "sample_id", "ts", "event_id", 86400, 4, 3600)


# Row after row with the times of the last three executed actions: the rule as it reads.
_EXECUTED = f"""
  WITH RECURSIVE h AS (SELECT * FROM ({DETECTIONS}) x WHERE is_anomaly OR is_zero_day),
  steps AS (SELECT event_id * 4 AS action_id, ts FROM h UNION ALL SELECT event_id * 4 + 1, ts FROM h WHERE severity IN ('critical', 'high')
            UNION ALL SELECT event_id * 4 + 2, ts FROM h WHERE is_zero_day UNION ALL SELECT event_id * 4 + 3, ts FROM h WHERE severity = 'critical'),
  d AS MATERIALIZED (SELECT action_id AS event_id, ts, row_number() OVER (ORDER BY ts, action_id) AS i FROM steps),
  run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS a, NULL::TIMESTAMP AS b, NULL::TIMESTAMP AS c, FALSE AS executed
          UNION ALL SELECT d.i, d.event_id, CASE WHEN ok THEN b ELSE a END, CASE WHEN ok THEN c ELSE b END, CASE WHEN ok THEN d.ts ELSE c END, ok
          FROM (SELECT run.*, d.i AS j, d.event_id AS e, d.ts AS t, run.a IS NULL OR run.a <= d.ts - INTERVAL 1 HOUR AS ok FROM run JOIN d ON d.i = run.i + 1) x JOIN d ON d.i = x.j)
  SELECT event_id AS action_id, executed FROM run WHERE i > 0"""


@query("actions_limited", _EXECUTED)
def _(spark, folder):
    actions = rules.response_actions(detections(spark, folder), True, True, True)
    actions = actions.select((col("event_id") * 4 + col("step")).alias("action_id"), "ts")
    return limits.action_limit(actions, "ts", "action_id", 3, 3600).select("action_id", "executed")


# --- streams --------------------------------------------------------------------------------------------------------

_EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark, folder):
    return readers.stream_parquet(spark, folder, _EVENT_SCHEMA, pattern="events.parquet")


def _run_to_table(spark, stream, name):
    out = work_path(spark, name)
    jobs.start(stream, jobs.append_table(out), work_path(spark, "progress")).awaitTermination()
    return jobs.read_runs(spark, out)


@query("stream_parquet", "SELECT event_id, event_type, value FROM events")
def _(spark, folder):
    stream = readers.stream_parquet(spark, folder, _EVENT_SCHEMA, columns=["event_id", "event_type", "value"], pattern="events.parquet")
    return _run_to_table(spark, stream, "rows")


def _event_files(spark, folder, fmt, files=4):
    path = work_path(spark, f"events-{fmt}")
    writer = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value").repartition(files, "event_id").write
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
    return path


_FILE_SCHEMA = "event_id long, user_id long, event_type string, value double"


@query("stream_csv", "SELECT event_id, value FROM events")
def _(spark, folder):
    stream = readers.stream_csv(spark, _event_files(spark, folder, "csv"), _FILE_SCHEMA, 2, ["event_id", "value"])
    return _run_to_table(spark, stream, "rows")


@query("stream_jsonl", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, folder):
    path = work_path(spark, "jsonl")
    lines = spark.read.text(_event_files(spark, folder, "json"))
    noise = lines.filter(F.xxhash64("value") % 7 == 0).select(F.concat(F.lit("{broken "), F.substring("value", 1, 9)).alias("value"))
    lines.unionAll(noise).write.text(path)
    return _run_to_table(spark, readers.stream_jsonl(spark, path, _FILE_SCHEMA, 3), "rows")


@query("stream_folder_watched", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, folder):
    stream = readers.watch_folder(spark, _event_files(spark, folder, "csv"), _FILE_SCHEMA, "*.csv", 1)
    return _run_to_table(spark, stream, "rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_NUMBERED = """SELECT k, r AS row, (r - 2) // 50 AS chunk, event_id, value, event_type FROM (
  SELECT event_id % 4 AS k, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS r, event_id, value, event_type FROM events) x WHERE r >= 2"""


def _numbered(spark, folder, fmt):
    """Four files in folders of their own, each in the order of event_id; streamed in two runs, the second with two new files."""
    path, out, progress = work_path(spark, "numbered"), work_path(spark, "rows"), work_path(spark, "progress")
    rows = table(spark, folder, "events").select("event_id", "value", "event_type", (col("event_id") % 4).alias("k"))
    ending = {"csv": "*.csv", "json": "*.json", "parquet": "*.parquet"}[fmt]
    for half in (0, 1):
        part = rows.filter(F.floor(col("k") / 2) == half).repartition(2, "k").sortWithinPartitions("k", "event_id")
        part.write.partitionBy("k").mode("append").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
        stream = row_files.stream_rows(spark, path, "event_id long, value double, event_type string", ending, 2, 50)
        jobs.start(stream, jobs.append_table(out), progress).awaitTermination()
    return jobs.read_runs(spark, out).select(F.regexp_extract("_file", "k=([0-9]+)", 1).cast("long").alias("k"), col("_row").alias("row"),
                                             col("_chunk").alias("chunk"), "event_id", "value", "event_type")


@query("stream_csv_rows", _NUMBERED)
def _(spark, folder):
    return _numbered(spark, folder, "csv")


@query("stream_jsonl_rows", _NUMBERED)
def _(spark, folder):
    return _numbered(spark, folder, "json")


@query("stream_parquet_rows", _NUMBERED)
def _(spark, folder):
    return _numbered(spark, folder, "parquet")


@query("stream_latency_percentiles", f"""
  SELECT event_type AS operation, count(*) AS samples, {sql_rnd('avg(value)')} AS mean, min(value) AS min, max(value) AS max, 3::BIGINT AS within_bound FROM events GROUP BY event_type""")
def _(spark, folder):
    """Percentiles over four micro-batches; their ranks in the whole table are at most samples / 10,000 (and one row) off."""
    path, out = _event_files(spark, folder, "json"), work_path(spark, "latency")
    stream = readers.stream_jsonl(spark, path, _FILE_SCHEMA, 1)
    jobs.running_latency(stream, "event_type", "value").writeStream.outputMode("complete").foreachBatch(jobs.overwrite_table(out)).option(
        "checkpointLocation", work_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), col(c).alias("q")) for p, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]))
    ranks = found.select("event_type", "samples", cells.alias("c")).join(table(spark, folder, "events").select("event_type", "value"), "event_type").groupBy(
        "event_type", "samples", "c").agg(F.count_if(col("value") < F.col("c.q")).alias("below"), F.count_if(col("value") <= F.col("c.q")).alias("upto"))
    slack = col("samples") / 10_000 + 1
    right = (col("below") <= F.col("c.p") * col("samples") + slack) & (col("upto") >= F.col("c.p") * col("samples") - slack)
    bound = ranks.groupBy("event_type").agg(F.count_if(right).alias("within_bound"))
    return rounded(found.join(bound, "event_type").select(col("event_type").alias("operation"), "samples", "mean", "min", "max", "within_bound"))


@query("stream_flushed", """
  WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
  SELECT event_type, 'size' AS reason, n // 64 * 64 AS rows, n // 64 AS batches FROM n WHERE n >= 64
  UNION ALL SELECT event_type, 'age', n % 64, 1 FROM n WHERE n % 64 > 0""")
def _(spark, folder):
    """Buffers of 64 rows per event type that wait for a second; the trigger has an interval, or no time would pass."""
    stream = flushing.flushed(_event_stream(spark, folder), 64, 1.0, "event_type")
    out, wanted = work_path(spark, "flushed"), table(spark, folder, "events").count()
    query_ = jobs.start(stream, jobs.append_table(out), work_path(spark, "progress"), "500 milliseconds")
    written = lambda: query_.lastProgress is not None and query_.lastProgress["batchId"] > 0 and jobs.read_runs(spark, out).count() == wanted
    jobs.run_until(query_, written, 180)
    rows = jobs.read_runs(spark, out)
    return rows.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("flush").alias("batches"))


def _fail_on(batch_id):
    def handler(batch, at):
        if at == batch_id:
            raise ValueError("refused")
        batch.write.mode("overwrite").format("noop").save()
    return handler


@query("stream_callback_outcomes", "SELECT i AS batch_id, i <> 2 AS success, (SELECT count(*) FROM events) AS rows FROM range(4) r(i)")
def _(spark, folder):
    stream = readers.stream_csv(spark, _event_files(spark, folder, "csv"), _FILE_SCHEMA, 1)
    outcomes = jobs.process_with_callback(stream, _fail_on(2), work_path(spark, "progress"), work_path(spark, "outcomes"))
    rows = table(spark, folder, "events").agg(F.count(F.lit(1)).alias("n")).scalar()
    return outcomes.select("batch_id", "success").withColumn("rows", rows)


@query("stream_fan_out", """SELECT route, handler, count(*) AS batches, count(*) FILTER (ok) AS succeeded FROM (
    SELECT 'all' AS route, h AS handler, i, h <> 'b' OR i <> 1 AS ok FROM range(4) r(i), (SELECT unnest(['a', 'b']) AS h) x
    UNION ALL SELECT 'round_robin', CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END, i, i <> 1 FROM range(4) r(i)
    UNION ALL SELECT 'b', 'b', i, i <> 1 FROM range(4) r(i)) y WHERE EXISTS (SELECT 1 FROM events) GROUP BY route, handler""")
def _(spark, folder):
    path = _event_files(spark, folder, "csv")
    handlers = {"a": _fail_on(-1), "b": _fail_on(1)}
    tables = []
    for route in ("all", "round_robin", "b"):
        out = work_path(spark, "outcomes")
        stream = readers.stream_csv(spark, path, _FILE_SCHEMA, 1)
        jobs.start(stream, jobs.dispatcher(handlers, out, route), work_path(spark, "progress")).awaitTermination()
        tables.append(spark.read.parquet(out).withColumn("route", F.lit(route)))
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return every.groupBy("route", "handler").agg(F.count(F.lit(1)).alias("batches"), F.count_if("success").alias("succeeded"))


@query("stream_running_counters", f"SELECT count(*) AS processed_count, count(*) FILTER (is_anomaly OR is_zero_day) AS alert_count, round(count(*) FILTER (is_anomaly OR is_zero_day) / count(*)::DOUBLE, 4) AS alert_rate FROM ({DETECTIONS}) d")
def _(spark, folder):
    out = work_path(spark, "counters")
    totals = jobs.running_counters(from_events(_event_stream(spark, folder)))
    query_ = totals.writeStream.outputMode("complete").foreachBatch(jobs.overwrite_table(out)).option(
        "checkpointLocation", work_path(spark, "progress")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(out)


@query("stream_history_metrics", f"""SELECT severity, count(*) AS total_detections, {sql_rnd('avg(is_anomaly::INT)')} AS anomaly_rate, {sql_rnd('avg(is_zero_day::INT)')} AS zero_day_rate,
  {sql_rnd('avg(anomaly_score)')} AS avg_anomaly_score, {sql_rnd('avg(detection_latency_ms)')} AS avg_latency_ms FROM ({DETECTIONS}) d GROUP BY severity""")
def _(spark, folder):
    from ..operators.opstats import history_metrics
    out = work_path(spark, "history")
    d = from_events(_event_stream(spark, folder)).withColumn("latency_ms", col("detection_latency_ms"))
    query_ = history_metrics(d, ["severity"]).writeStream.outputMode("complete").foreachBatch(jobs.overwrite_table(out)).option(
        "checkpointLocation", work_path(spark, "progress")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return rounded(spark.read.parquet(out))


@query("stream_cool_down", f"{_COOL} SELECT * FROM cooled")
def _(spark, folder):
    hits = from_events(_event_stream(spark, folder)).filter("is_anomaly").select("event_id", col("ts").cast("timestamp").alias("ts"), "sample_id")
    hits = hits.withColumn("sample_id", F.when(col("event_id") % 13 != 5, col("sample_id")))
    cooled = stateful.cool_down_stream(hits, "sample_id", "ts", "event_id", 86400)
    return _run_to_table(spark, cooled, "cooled").withColumn("ts", col("ts").cast("timestamp_ntz"))


@query("stream_alerts_per_minute", _TOP.format(source=f"(SELECT * FROM ({DETECTIONS}) x WHERE is_anomaly) z"))
def _(spark, folder):
    hits = from_events(_event_stream(spark, folder)).filter("is_anomaly").select("event_id", col("ts").cast("timestamp").alias("ts"), "sample_id")
    kept = stateful.per_minute_limit_stream(hits, "ts", "event_id", 4, 3600)
    return _run_to_table(spark, kept, "limited").withColumn("ts", col("ts").cast("timestamp_ntz"))


def _files_by_time(spark, df, ts, parts=3):
    """A stream of ``parts`` files, one per micro-batch, each later than the one before."""
    path = work_path(spark, "by-time")
    seconds = F.unix_micros(col(ts).cast("timestamp"))
    ends = df.agg(F.percentile_approx(seconds, [k / parts for k in range(1, parts)])).first()[0]
    nth = sum(((seconds > e).cast("int") for e in ends), F.lit(0))
    for k in range(parts):
        df.filter(nth == k).coalesce(1).write.mode("append").parquet(path)
    return readers.stream_parquet(spark, path, df.schema, 1)


def _carried(spark, stream, step, state):
    out = work_path(spark, "rows")
    jobs.start(stream, carried.carried(step, state, work_path(spark, "state"), out), work_path(spark, "progress")).awaitTermination()
    return jobs.read_runs(spark, out)


@query("stream_cool_down_carried", f"{_COOL} SELECT * FROM cooled")
def _(spark, folder):
    stream = _files_by_time(spark, _sourced(spark, folder), "ts")
    return _carried(spark, stream, carried.cool_down_step("sample_id", "ts", "event_id", 86400), carried.COOL_DOWN_STATE)


@query("stream_alerts_per_anchored_minute", ORACLE["alerts_per_anchored_minute"])
def _(spark, folder):
    stream = _files_by_time(spark, _hits(spark, folder), "ts")
    return _carried(spark, stream, carried.anchored_minute_step("ts", "event_id", 4, 3600), carried.MINUTE_STATE).drop("_minute_start")


@query("stream_actions_limited", _EXECUTED)
def _(spark, folder):
    actions = rules.response_actions(detections(spark, folder), True, True, True)
    actions = actions.select((col("event_id") * 4 + col("step")).alias("action_id"), "ts")
    stream = _files_by_time(spark, actions, "ts")
    step = carried.sliding_limit_step("ts", "action_id", 3, 3600)
    return _carried(spark, stream, step, carried.sliding_limit_state(actions)).select("action_id", "executed")


# Depth of the written-out trees of the detector, and the score that follows: offsets 0.88 and 0.8 flag different rows.
_SWAPPED = f"""
  WITH p AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id % 4 AS part FROM events),
       d AS (SELECT *, -pow(2.0, -((CASE WHEN value <= 30.0 THEN CASE WHEN k <= 40.0 THEN 2.0 ELSE 3.0 END ELSE 1.0 END::DOUBLE
                                   + CASE WHEN k <= 40.0 THEN CASE WHEN value <= 30.0 THEN 2.0 ELSE 3.0 END ELSE 1.5 END::DOUBLE) / 2.0) / {_UNIT!r}) AS raw FROM p)
  SELECT event_id, CASE WHEN part < 2 THEN 'v1' ELSE 'v2' END AS model_version, raw + CASE WHEN part < 2 THEN 0.88 ELSE 0.8 END < 0 AS is_anomaly,
         {sql_rnd('1.0 / (1.0 + exp(raw + CASE WHEN part < 2 THEN 0.88 ELSE 0.8 END))')} AS anomaly_score FROM d"""


@query("stream_models_swapped", _SWAPPED)
def _(spark, folder):
    """Two micro-batches by the first version, then another is published, and two more follow; the files arrive one after the other."""
    store = model_store.ModelStore(spark, work_path(spark, "models"))
    path, out, progress = work_path(spark, "flows"), work_path(spark, "detections"), work_path(spark, "progress")
    events = _events(spark, folder)
    handler = jobs.scoring_handler(store.models, col("event_id"), out)
    for part in range(4):
        if part % 2 == 0:
            store.publish(replace(_detector(), offset=-0.88 if part == 0 else -0.8))
        events.filter(col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
        jobs.start(readers.stream_parquet(spark, path, events.schema, 1), handler, progress).awaitTermination()
    return rounded(jobs.read_runs(spark, out).select("event_id", "model_version", "is_anomaly", "anomaly_score"))


@query("stream_detections", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, TRUE AS same_as_batch, TRUE AS alerts_complete FROM events")
def _(spark, folder):
    from ..operators.detect import detect
    forest, classifier = models(spark, folder)
    path = work_path(spark, "flows")
    events = _events(spark, folder)
    events.repartition(3, "event_id").write.parquet(path)
    out, alerts = work_path(spark, "detections"), work_path(spark, "alerts")
    stream = readers.stream_parquet(spark, path, events.schema, 1)
    sample = F.concat(F.lit("user_"), col("user_id").cast("string"))
    handler = jobs.scoring_handler(lambda batch_id: (forest, classifier, f"v{batch_id % 2}"), sample, out, alerts)
    jobs.start(stream, handler, work_path(spark, "progress")).awaitTermination()
    streamed = jobs.read_runs(spark, out)
    batch = detect(events, forest, classifier, sample)
    same = streamed.select("event_id", "predicted_class", "is_anomaly").join(
        batch.select("event_id", col("predicted_class").alias("c"), col("is_anomaly").alias("a")), "event_id")
    written = alert_store.read_alerts(spark, f"{alerts}/json").agg(F.count(F.lit(1)).alias("n")).scalar()
    expected = F.count_if(col("a"))
    return same.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("ids"),
                    F.bool_and((col("predicted_class") == col("c")) & (col("is_anomaly") == col("a"))).alias("same_as_batch"),
                    expected.alias("_n")).select("rows", "ids", "same_as_batch", (col("_n") == written).alias("alerts_complete"))
