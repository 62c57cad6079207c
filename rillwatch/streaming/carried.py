"""Limits over micro-batches: each batch goes through the batch operator, and what later batches must know is carried on.

A stateful operator folds a key's rows of a batch in one task. Here a batch is a table like any other, so a source that has all of
its rows is cut into slices of time by the operators in :mod:`rillwatch.operators.limits`. The state is a small table per batch:
the last kept time of each source, the minute that is open, the times of the last executed actions. A batch that is run again after
a failure reads the state of the batch before it and replaces its own rows and state, so nothing counts twice.

Rows older than what the state has already decided on are late: a cool-down and a sliding limit suppress them, an anchored minute
drops them if its start has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ACTIONS_PER_MINUTE, ALERTS_PER_MINUTE, COOL_DOWN_SECONDS
from ..core import col, join_stats
from ..operators import limits
from .jobs import Handler, held

#: (rows of a batch, state before it) -> (rows to write, state after it from the rows as written)
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]]


def carried(step: Step, state_schema: str, state_path: str, out_path: str) -> Handler:
    """A handler that writes one folder of rows and one of state per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(state_schema).parquet(f"{state_path}/after={batch_id - 1}") if batch_id else spark.createDataFrame([], state_schema)
        rows = held(batch)
        try:
            found, after = step(rows, before)
            found.write.mode("overwrite").parquet(f"{out_path}/run={batch_id}")
            written = spark.read.schema(found.schema).parquet(f"{out_path}/run={batch_id}")
            after(written).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/after={batch_id}")
        finally:
            rows.unpersist()

    return handle


COOL_DOWN_STATE = "named string, kept long"


def cool_down_step(source: str, ts: str, ident: str, seconds: float = COOL_DOWN_SECONDS, late_seconds: float = 60) -> Step:
    """At most one row per source within ``seconds`` of the last kept one, over all batches.

    State: the last kept time of each source, until its cool-down ended ``late_seconds`` before the newest kept row.
    """
    wait = int(seconds * 1_000_000)
    named = F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("-")).alias("named")

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        known = join_stats(rows.withColumn("named", named), before, ["named"])
        fresh = known.filter(col("kept").isNull() | (limits.micros(col(ts)) >= col("kept") + wait)).select(*[col(c) for c in rows.columns])

        def after(written: DataFrame) -> DataFrame:
            both = before.unionByName(written.select(named, limits.micros(col(ts)).alias("kept"))).groupBy("named").agg(F.max("kept").alias("kept"))
            newest = both.agg(F.max("kept")).first()[0]
            return both.filter(col("kept") + wait >= (newest or 0) - int(late_seconds * 1_000_000))

        return limits.cool_down(fresh, source, ts, ident, seconds), after

    return step


MINUTE_STATE = "start long, used long"


def anchored_minute_step(ts: str, ident: str, limit: int = ALERTS_PER_MINUTE, seconds: float = 60) -> Step:
    """The first ``limit`` rows of each minute that starts at the first row more than ``seconds`` after the last start.

    Rows of the open minute fill it up, the first row beyond it starts the next. State: the start of the open minute and its rows.
    """
    span = int(seconds * 1_000_000)

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        open_minute = before.first()  # one row at most
        t = limits.micros(col(ts))
        if open_minute is None:
            found = limits.anchored_minute_limit(rows, ts, ident, limit, seconds, "_minute_start")
        else:
            start, used = open_minute
            room = rows.filter((t >= start) & (t <= start + span)).orderBy(ts, ident).limit(max(0, limit - used)).withColumn("_minute_start", F.lit(start).cast("long"))
            found = room.unionByName(limits.anchored_minute_limit(rows.filter(t > start + span), ts, ident, limit, seconds, "_minute_start"))

        def after(written: DataFrame) -> DataFrame:
            counted = before.select("start", "used").unionByName(written.groupBy(col("_minute_start").alias("start")).agg(F.count(F.lit(1)).alias("used")))
            return counted.groupBy("start").agg(F.sum("used").alias("used")).orderBy(F.desc("start")).limit(1)

        return found, after

    return step


def sliding_limit_state(df: DataFrame, by: Sequence[str] = ()) -> str:
    """Schema of the state for streams like ``df``."""
    types = dict(df.dtypes)
    return ", ".join([*[f"`{k}` {types[k]}" for k in by], "t long", "n long"])


def sliding_limit_step(ts: str, ident: str, limit: int = ACTIONS_PER_MINUTE, seconds: int = 60, by: Sequence[str] = ()) -> Step:
    """Adds ``executed``: fewer than ``limit`` executed actions in the last ``seconds``, over all batches.

    An action older than the last executed one of an earlier batch is late and not executed. State: the executed times that still
    count, at most ``limit`` per stream.
    """
    span, keys = seconds * 1_000_000, list(by)

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        whose = F.struct(*[col(k) for k in keys]) if keys else F.lit(0)  # structs with nulls in the same places are equal
        ends = before.groupBy(whose.alias("_by")).agg(F.max("t").alias("_last"))
        known = join_stats(rows.withColumn("_by", whose), ends, ["_by"]).drop("_by")
        in_time = col("_last").isNull() | (limits.micros(col(ts)) >= col("_last"))
        judged = limits.action_limit(known.filter(in_time).drop("_last"), ts, ident, limit, seconds, keys, before)
        late = known.filter(~in_time).drop("_last").withColumn("executed", F.lit(False))

        def after(written: DataFrame) -> DataFrame:
            own = [col(k) for k in keys]
            done = written.filter("executed").groupBy(*own, limits.micros(col(ts)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
            every = before.unionByName(done).groupBy(*own, "t").agg(F.sum("n").alias("n")).withColumn("_by", whose)
            both = join_stats(every, every.groupBy("_by").agg(F.max("t").alias("_newest")), ["_by"], "inner")
            return both.filter(col("t") > col("_newest") - span).select(*own, "t", "n")

        return judged.unionByName(late), after

    return step
