"""Alert tables: JSON-lines and CSV sinks with a folder per day, reading back, retention, dispatch and reports."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ALERT_COLUMNS
from ..core import col, join_stats
from ..errors import DataError


_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def stamped(alerts: DataFrame, now: Column | None = None) -> DataFrame:
    """A timestamp where there is none, and the day it falls on."""
    now = now if now is not None else F.current_timestamp()
    given = col("timestamp") if "timestamp" in alerts.columns else F.lit(None)
    ts = F.coalesce(given.cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    return alerts.withColumn("timestamp", ts).withColumn("alert_date", ts.cast("date"))


def write_json(alerts: DataFrame, path: str, mode: str = "append") -> None:
    (stamped(alerts).write.mode(mode).partitionBy("alert_date").option("timestampNTZFormat", _MICROS)
     .option("timestampFormat", _MICROS).json(path))


def csv_columns(alerts: DataFrame) -> DataFrame:
    """The nine columns of the CSV form, in order; what is missing is an empty text."""
    have = {c: col(c).cast("string") for c in alerts.columns}
    return alerts.select(*[F.coalesce(have.get(c, F.lit(None)), F.lit("")).alias(c) for c in ALERT_COLUMNS])


def write_csv(alerts: DataFrame, path: str, mode: str = "append") -> None:
    dated = stamped(alerts)
    rows = dated.select(*[F.coalesce(col(c).cast("string") if c in dated.columns else F.lit(None), F.lit("")).alias(c)
                          for c in ALERT_COLUMNS], "alert_date")
    rows.write.mode(mode).partitionBy("alert_date").option("header", True).option("emptyValue", "").csv(path)


def write_alerts(alerts: DataFrame, path: str, fmt: str = "json", mode: str = "append", run: int | None = None) -> None:
    """``json``, ``csv``, or both for any other name. A stream gives its batch number as ``run`` and overwrites that run."""
    below = "" if run is None else f"/run={run}"
    if fmt != "csv":
        write_json(alerts, f"{path}/json{below}", mode)
    if fmt != "json":
        write_csv(alerts, f"{path}/csv{below}", mode)


ALERT_SCHEMA = ("timestamp timestamp_ntz, alert_id string, severity string, predicted_class string, anomaly_score double, "
                "classification_confidence double, is_zero_day boolean, sample_id string, message string")


def read_alerts(spark: SparkSession, path: str, fmt: str = "json", limit: int | None = None,
                schema: str = ALERT_SCHEMA) -> DataFrame:
    """Alerts of a folder; a filter on alert_date reads only the days it needs. ``limit`` is the caller's page size: the
    first alerts by time and id."""
    if fmt not in ("json", "csv"):
        raise DataError(f"unknown alert format: {fmt}")
    dated = f"{schema}, alert_date date"
    rows = (spark.read.schema(dated).json(path) if fmt == "json"
            else spark.read.schema(dated).option("header", True).csv(path))
    return rows.orderBy("timestamp", "alert_id").limit(limit) if limit else rows


def older_than(alerts: DataFrame, cutoff: date) -> DataFrame:
    return alerts.filter(col("alert_date") < F.lit(cutoff))


def newest_days(alerts: DataFrame, days: int) -> DataFrame:
    """Alerts of the newest days that have any. The ranking sees one row per day."""
    dates = alerts.select("alert_date").distinct()
    kept = dates.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("alert_date")))).filter(col("_r") <= days)
    return join_stats(alerts, kept.select("alert_date"), ["alert_date"], "left_semi")


def archive(spark: SparkSession, path: str, archive_path: str, cutoff: date, fmt: str = "json") -> int:
    """Copy the days before the cutoff to the archive, then remove their folders. Returns the number of days moved.

    Works on folders per day and on those per run and day that a stream writes. The rows are written before anything is
    removed, so an interruption leaves them in both places and not in none; run again, it leaves out the alerts that the
    archive has already. The loop is over days.
    """
    old = older_than(read_alerts(spark, path, fmt), cutoff).drop("run")
    days = [r[0] for r in old.select("alert_date").distinct().collect()]
    if not days:
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop.Path(archive_path)):
        had = read_alerts(spark, archive_path, fmt).select("alert_id", "alert_date")
        old = old.join(had, ["alert_id", "alert_date"], "left_anti")
    writer = old.write.mode("append").partitionBy("alert_date")
    writer.option("timestampNTZFormat", _MICROS).json(archive_path) if fmt == "json" else writer.option("header", True).csv(archive_path)
    for day in days:
        for layout in (f"{path}/alert_date={day}", f"{path}/run=*/alert_date={day}"):
            for found in files.globStatus(hadoop.Path(layout)) or []:
                files.delete(found.getPath(), True)
    return len(days)


def dispatch(alerts: DataFrame, path: str, now: Column | None = None) -> int:
    """Write alerts with ``dispatched_at``; the number written is observed in the same job."""
    seen = Observation(f"dispatch-{uuid.uuid4().hex}")
    sent = alerts.withColumn("dispatched_at", now if now is not None else F.current_timestamp())
    write_json(sent.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def save_report(report: DataFrame, path: str) -> None:
    """Each report row as one nested JSON text."""
    report.select(F.to_json(F.struct(*[col(c) for c in report.columns])).alias("value")).write.mode("overwrite").text(path)
