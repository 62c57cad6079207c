"""Micro-batch jobs: callbacks, fan-out to handlers, running counters, and the scoring job with its alert sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import DataError
from ..functions.rules import generated_alerts
from ..operators.classify import Classifier
from ..operators.detect import detect
from ..operators.forest import Forest
from ..sources import alert_store

Handler = Callable[[DataFrame, int], object]
_OUTCOME = "batch_id long, handler string, success boolean, error string"


def held(df: DataFrame) -> DataFrame:
    """Keep a micro-batch that several sinks read; lost blocks are computed again from the source files."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def start(stream: DataFrame, handler: Handler, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``handler`` on each micro-batch; without an interval everything available is processed and the query ends."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_until(query: StreamingQuery, done: Callable[[], bool], seconds: float, poll: float = 0.5) -> bool:
    """Let a query with an interval run until ``done`` holds or the time is over, then stop it; whether it held."""
    end = time.monotonic() + seconds
    try:
        while query.isActive and not done() and time.monotonic() < end:
            time.sleep(poll)
        if query.exception():
            raise query.exception()
        return done()
    finally:
        query.stop()


def _run(name: str, handler: Handler, batch: DataFrame, batch_id: int) -> tuple:
    try:
        handler(batch, batch_id)
        return batch_id, name, True, None
    except Exception as error:  # one failing handler must not stop the stream or the others
        return batch_id, name, False, str(error)


def dispatcher(handlers: Mapping[str, Handler], outcome_path: str, route: str = "all") -> Handler:
    """A handler that passes each batch to all handlers, to one by name, or to one in turn (``round_robin``).

    Outcomes go to a table with a folder per batch, overwritten when a batch is run again after a failure.
    """
    names = list(handlers)

    def chosen(batch_id: int) -> list[str]:
        if route == "all":
            return names
        if route == "round_robin":
            return [names[batch_id % len(names)]] if names else []
        return [route]

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = held(batch)
        try:
            outcomes = [_run(n, handlers[n], rows, batch_id) if n in handlers
                        else (batch_id, n, False, f"Handler '{n}' not found") for n in chosen(batch_id)]
            outcomes = outcomes or [(batch_id, "none", False, "No handlers registered")]
            batch.sparkSession.createDataFrame(outcomes, _OUTCOME).coalesce(1).write.mode("overwrite").parquet(
                f"{outcome_path}/run={batch_id}")
        finally:
            rows.unpersist()

    return handle


def process_with_callback(stream: DataFrame, callback: Handler, checkpoint: str, outcome_path: str) -> DataFrame:
    """Run a callback on everything available; a failed batch is recorded and does not count. Returns the outcomes."""
    if callback is None:
        raise DataError("no callback given")
    start(stream, dispatcher({"callback": callback}, outcome_path), checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(_OUTCOME).parquet(outcome_path)


def running_counters(stream: DataFrame) -> DataFrame:
    """Totals over all batches so far, as a streaming aggregate for complete mode."""
    alert = F.coalesce(F.col("is_anomaly") | F.col("is_zero_day"), F.lit(False))
    return stream.groupBy().agg(F.count(F.lit(1)).alias("processed_count"), F.count_if(alert).alias("alert_count")).withColumn(
        "alert_rate", F.round(F.col("alert_count") / F.greatest(F.col("processed_count"), F.lit(1)), 4))


def running_latency(stream: DataFrame, operation: str, duration: str, probs: Sequence[float] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Per operation so far, as a streaming aggregate for complete mode: samples, mean, min, max, and ``p50`` and so on.

    The state of an operation is a digest that merges: its quantiles are at most samples / ``accuracy`` ranks off. A null operation is
    one of its own; missing durations don't count.
    """
    at = F.percentile_approx(duration, [float(p) for p in probs], accuracy)
    made = stream.groupBy(operation).agg(F.count(duration).alias("samples"), F.avg(duration).alias("mean"), F.min(duration).alias("min"),
                                         F.max(duration).alias("max"), at.alias("_at"))
    return made.select(operation, "samples", "mean", "min", "max", *[F.col("_at")[i].alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(probs)])


def overwrite_table(path: str) -> Handler:
    """A handler that replaces a table by each batch: for aggregates in complete mode."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(path)


def append_table(path: str) -> Handler:
    """A handler that writes one folder per batch; a batch run again replaces its own folder, so no row is doubled."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/run={batch_id}")


Models = Callable[[int], tuple[Forest | None, Classifier | None, str]]


def scoring_handler(models: Models, sample_id: Column, detections_path: str, alerts_path: str | None = None,
                    fmt: str = "json", timestamp: Column | None = None) -> Handler:
    """Score a micro-batch, store the detections with the version of the models, and write its alerts.

    ``models`` is asked at every batch, so models are swapped by letting it return others.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        forest, classifier, version = models(batch_id)
        parts: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            parts.append(held(df))
            return parts[-1]

        try:
            found = detect(batch, forest, classifier, sample_id, hold=keep).withColumn("model_version", F.lit(version))
            out = f"{detections_path}/run={batch_id}"
            found.write.mode("overwrite").parquet(out)
            if alerts_path:
                stored = batch.sparkSession.read.parquet(out)  # written once; alerts come from the stored rows
                alert_store.write_alerts(generated_alerts(stored, timestamp=timestamp), alerts_path, fmt, "overwrite", batch_id)
        finally:
            for part in parts:
                part.unpersist()

    return handle


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a table written by :func:`append_table` or the scoring job."""
    return spark.read.parquet(path).drop("run")
