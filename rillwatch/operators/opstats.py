"""Statistics of detections, alerts and operations, in long form: one row per (breakdown, key) instead of maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SEVERITY_RANKED
from ..core import col, count_when, join_stats, one_row
from ..functions.rules import threat_level
from ..ordering import add_position, add_running_totals
from ..quantiles import exact_quantiles, floor_index_quantiles


# --- detections -----------------------------------------------------------------------------------------------------

def detection_totals(d: DataFrame) -> DataFrame:
    """One row of totals, rates and means."""
    n = F.count(F.lit(1))
    return d.agg(n.alias("total_samples"), count_when(col("is_anomaly")).alias("anomalies_detected"),
                 (n - count_when(col("is_anomaly"))).alias("normal_samples"),
                 count_when(col("is_zero_day")).alias("zero_day_detected"),
                 F.coalesce(F.try_divide(count_when(col("is_anomaly")), n), F.lit(0.0)).alias("anomaly_rate"),
                 F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("mean_anomaly_score"),
                 F.coalesce(F.avg("classification_confidence"), F.lit(0.0)).alias("mean_classification_confidence"),
                 F.coalesce(F.avg("detection_latency_ms"), F.lit(0.0)).alias("mean_latency_ms"))


def breakdown(d: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(breakdown, key, n, zero_days): the total and each column's counts from one pass with grouping sets."""
    columns = columns or {"severity": "severity", "class": "predicted_class"}
    names = list(columns.values())
    sets = [[], *[[col(c)] for c in names]]
    grouped = d.groupingSets(sets, *[col(c) for c in names]).agg(
        F.grouping_id(*[col(c) for c in names]).alias("_g"), F.count(F.lit(1)).alias("n"),
        count_when(col("is_zero_day")).alias("zero_days"))
    everything = (1 << len(names)) - 1
    code = {k: everything & ~(1 << (len(names) - 1 - i)) for i, k in enumerate(columns)}
    kind = F.when(col("_g") == everything, "total")
    key = F.when(col("_g") == everything, "")
    for k, c in columns.items():
        kind = kind.when(col("_g") == code[k], k)
        key = key.when(col("_g") == code[k], col(c))
    return grouped.select(kind.alias("breakdown"), key.alias("key"), "n", "zero_days")


def history_metrics(d: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates and means over the history, or per batch or time bucket; also works on a stream in complete mode."""
    n = F.count(F.lit(1))
    return d.groupBy(*by).agg(n.alias("total_detections"), (count_when(col("is_anomaly")) / n).alias("anomaly_rate"),
                              (count_when(col("is_zero_day")) / n).alias("zero_day_rate"),
                              F.avg("anomaly_score").alias("avg_anomaly_score"), F.avg("latency_ms").alias("avg_latency_ms"))


def batch_summary(d: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: samples, alerts (anomaly or zero-day), counts, and running totals with the running alert rate.

    A large table has very many batches, so their totals are accumulated in range partitions as well.
    """
    per = d.groupBy(batch).agg(F.count(F.lit(1)).alias("total_samples"),
                               count_when(col("is_anomaly") | col("is_zero_day")).alias("total_alerts"),
                               count_when(col("is_anomaly")).alias("anomaly_count"),
                               count_when(col("is_zero_day")).alias("zero_day_count"))
    run = add_running_totals(per, [batch], {"processed_count": "total_samples", "alert_count": "total_alerts"})
    return run.withColumn("alert_rate", F.round(col("alert_count") / F.greatest(col("processed_count"), F.lit(1)), 4))


def threat_levels(d: DataFrame, by: str) -> DataFrame:
    rate = count_when(col("is_anomaly")) / F.count(F.lit(1)) * 100
    return d.groupBy(by).agg(rate.alias("rate_percent")).withColumn("threat", threat_level(col("rate_percent")))


def severity_counts(d: DataFrame) -> DataFrame:
    """(position, severity, n), most severe first; absent levels have no row."""
    ranked = list(reversed(SEVERITY_RANKED))
    at = F.array_position(F.array(*[F.lit(s) for s in ranked]), col("severity")).cast("int")
    return (d.filter(col("severity").isin(ranked)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
            .select(at.alias("position"), "severity", "n").orderBy("position"))


def hourly_counts(d: DataFrame, ts: str = "ts") -> DataFrame:
    return d.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n")).orderBy("hour")


def alert_timeline(alerts: DataFrame, ts: str = "ts", zero_day_only: bool = False) -> DataFrame:
    rows = alerts.filter("is_zero_day") if zero_day_only else alerts
    return rows.select(col(ts).alias("timestamp"), "anomaly_score", "severity", "is_zero_day").orderBy("timestamp")


def series(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.select(F.to_timestamp_ntz(col(ts)).alias("timestamp"), col(value).alias("value")).orderBy("timestamp")


def score_histogram(df: DataFrame, score: str, group: str, bins: int = 50) -> DataFrame:
    """(group, bin, n, density) of equal bins between each group's own extremes; the last bin is closed."""
    ends = df.groupBy(group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("rows"))
    width = (col("hi") - col("lo")) / bins
    place = F.least(F.coalesce(F.try_divide(col(score) - col("lo"), width), F.lit(0.0)).cast("int"), F.lit(bins - 1))
    counted = (join_stats(df.select(group, score), ends, [group]).groupBy(group, place.alias("bin"), "lo", "hi", "rows")
               .agg(F.count(F.lit(1)).alias("n")))
    return counted.select(group, "bin", (col("lo") + width * col("bin")).alias("left"), "n",
                          F.try_divide(col("n").cast("double"), col("rows") * width).alias("density"))


# --- operations -----------------------------------------------------------------------------------------------------

def latency_statistics(log: DataFrame, operation: str = "operation", duration: str = "duration_ms") -> DataFrame:
    """Per operation and overall (``overall`` is true): count, mean, population deviation, extremes, linear percentiles, total.

    Rows without an operation are a group of their own, told from the overall row by ``overall``.
    """
    probs = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    moments = [F.count(duration).alias("count"), F.avg(duration).alias("mean_ms"), F.stddev_pop(duration).alias("std_ms"),
               F.min(duration).alias("min_ms"), F.max(duration).alias("max_ms"), F.sum(duration).alias("total_ms")]
    table = log.rollup(col(operation)).agg((F.grouping(col(operation)) == 1).alias("overall"), *moments)
    spread = [F.max(F.when(col("prob") == p, col("quantile"))).alias(n) for n, p in probs.items()]
    each = exact_quantiles(log, [duration], list(probs.values()), [operation]).groupBy(operation).agg(*spread)
    whole = exact_quantiles(log, [duration], list(probs.values())).agg(*spread)
    none = F.lit(None).cast(dict(log.dtypes)[operation])
    quantiles = each.select(col(operation).alias("_op"), F.lit(False).alias("_all"), *probs).unionByName(
        whole.select(none.alias("_op"), F.lit(True).alias("_all"), *probs))
    same = (col("overall") == col("_all")) & col(operation).eqNullSafe(col("_op"))
    return table.join(quantiles, same, "left").select(
        operation, "overall", "count", "mean_ms", "std_ms", "min_ms", "max_ms", *probs, "total_ms")


def throughput_statistics(log: DataFrame, operation: str = "operation") -> DataFrame:
    """Per operation: rates of the single measurements, and total samples over total time."""
    rate = F.when(col("elapsed_s") > 0, col("samples") / col("elapsed_s")).otherwise(0.0)
    rated = log.select(operation, "samples", "elapsed_s", rate.alias("rate"))
    return rated.groupBy(operation).agg(
        F.count(F.lit(1)).alias("measurements"), F.sum("samples").alias("total_samples"), F.sum("elapsed_s").alias("total_time_s"),
        F.avg("rate").alias("mean_rate"), F.stddev_pop("rate").alias("std_rate"), F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
        F.coalesce(F.try_divide(F.sum("samples").cast("double"), F.sum("elapsed_s")), F.lit(0.0)).alias("avg_rate"))


def floor_latency(log: DataFrame, duration: str = "duration_ms") -> DataFrame:
    """One row: mean, extremes and the order statistics ``sorted[int(n * p)]``."""
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    at = one_row(floor_index_quantiles(log, duration, list(probs.values())).agg(*[
        F.max(F.when(col("prob") == p, col("quantile"))).alias(n) for n, p in probs.items()]))
    return log.agg(F.avg(duration).alias("avg_latency_ms"), F.min(duration).alias("min_latency_ms"),
                   F.max(duration).alias("max_latency_ms"), F.count(duration).alias("total_measurements")).select(
        "avg_latency_ms", *[at.getField(n).alias(f"{n}_latency_ms") for n in probs], "min_latency_ms", "max_latency_ms",
        "total_measurements")


def box_statistics(log: DataFrame, value: str) -> DataFrame:
    """One row: min, ``sorted[n//4]``, ``[n//2]``, ``[3n//4]``, max, mean."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    at = one_row(floor_index_quantiles(log, value, list(probs.values())).agg(*[
        F.max(F.when(col("prob") == p, col("quantile"))).alias(n) for n, p in probs.items()]))
    ends = log.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return ends.select("min", *[at.getField(n).alias(n) for n in probs], "max", "mean")


def batch_statistics(batches: DataFrame) -> DataFrame:
    """One row over a batch log (size, queue_ms, processing_ms): totals, means and 95th percentiles."""
    p95 = one_row(exact_quantiles(batches, ["queue_ms", "processing_ms"], [0.95]).agg(*[
        F.max(F.when(col("column") == c, col("quantile"))).alias(c) for c in ("queue_ms", "processing_ms")]))
    return batches.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_samples"),
                       F.avg("size").alias("avg_batch_size"), F.avg("queue_ms").alias("avg_queue_time_ms"),
                       F.avg("processing_ms").alias("avg_processing_time_ms")).select(
        "*", p95.getField("queue_ms").alias("p95_queue_time_ms"), p95.getField("processing_ms").alias("p95_processing_time_ms"))


def handler_statistics(outcomes: DataFrame, handler: str = "handler") -> DataFrame:
    n = F.count(F.lit(1))
    return outcomes.groupBy(handler).agg(n.alias("total"), count_when(col("success")).alias("success"),
                                         (n - count_when(col("success"))).alias("failed"),
                                         (count_when(col("success")) / n).alias("success_rate"))


def action_statistics(actions: DataFrame) -> DataFrame:
    """(action_type, overall, total, successful, failed); ``overall`` tells the row over all types from actions without one."""
    n = F.count(F.lit(1))
    return actions.rollup("action_type").agg((F.grouping("action_type") == 1).alias("overall"), n.alias("total"), count_when(col("success")).alias("successful"),
                                             (n - count_when(col("success"))).alias("failed"))


def last_actions(actions: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return actions.orderBy(*[F.desc(o) for o in order]).limit(n)


# --- framing --------------------------------------------------------------------------------------------------------

def with_batches(df: DataFrame, order: Sequence[str | Column], size: int, max_rows: int | None = None) -> DataFrame:
    """Cuts the ordered table into consecutive batches: adds position and batch_id; ``max_rows`` is the stream's own limit."""
    placed = add_position(df, order)
    if max_rows is not None:
        placed = placed.filter(col("position") < max_rows)
    return placed.withColumn("batch_id", F.floor(col("position") / size))


def row_range(df: DataFrame, order: Sequence[str | Column], start: int, end: int) -> DataFrame:
    """Rows start <= position < end of the ordered table."""
    return add_position(df, order).filter((col("position") >= start) & (col("position") < end))


def sliding_windows(df: DataFrame, order: Sequence[str | Column], size: int, step: int = 1) -> DataFrame:
    """Each row once per sliding window that covers it, with window_start and window_end (exclusive).

    Windows start every ``step`` rows; the first one that reaches the end of the table is cut there and is the last.
    """
    placed = add_position(df, order)
    total = one_row(placed.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    held = placed.withColumn("_n", total)
    final = F.when(col("_n") <= size, F.lit(0)).otherwise(F.ceil((col("_n") - size) / step))
    low = F.greatest(F.ceil((col("position") - size + 1) / step), F.lit(0))
    high = F.least(F.floor(col("position") / step), final)
    return (held.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi")
            .withColumn("_w", F.explode(F.sequence(col("_lo"), col("_hi"))))
            .select(*[col(c) for c in df.columns], "position", (col("_w") * step).alias("window_start"),
                    F.least(col("_w") * step + size, col("_n")).alias("window_end")))
