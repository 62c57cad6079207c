"""Buffers that are flushed by size or by age, as state of a stream.

Rows of a key wait in a list state. As soon as ``size`` rows are there they leave as one batch; a processing-time timer, set when the
first row arrives in an empty buffer, sends what is there after ``seconds``. A buffer never holds ``size`` rows or more, whatever
arrives in a micro-batch: chunks of it leave as they fill up. Needs the state store that keeps several states per key (RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..core import col
from ..errors import DataError

STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BY_SIZE, BY_AGE = "size", "age"


def use_state_store(spark: SparkSession) -> None:
    """Let streams of this session keep several states per key; a store that is set stays."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, _ROCKS)


class _Buffer(StatefulProcessor):
    def __init__(self, schema: T.StructType, size: int, seconds: float):
        self.schema, self.size, self.wait_ms = schema, size, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.known = handle.getValueState("known", "n long, flushed long, timer long")

    def _state(self) -> tuple[int, int, int]:
        return tuple(self.known.get()) if self.known.exists() else (0, 0, 0)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.rows.get()), columns=self.schema.fieldNames(), dtype=object)

    def _batch(self, rows: pd.DataFrame, number: int, reason: str) -> pd.DataFrame:
        return rows.assign(flush=np.full(len(rows), number), reason=reason, flush_rows=np.full(len(rows), len(rows)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, flushed, timer = self._state()
        for chunk in rows:
            chunk = chunk[self.schema.fieldNames()]
            if n + len(chunk) >= self.size:
                both = pd.concat([self._held(), chunk], ignore_index=True) if n else chunk
                full = len(both) // self.size * self.size
                for start in range(0, full, self.size):
                    flushed += 1
                    yield self._batch(both.iloc[start:start + self.size], flushed, BY_SIZE)
                self.rows.clear()
                if timer:
                    self.handle.deleteTimer(timer)
                chunk, n, timer = both.iloc[full:], 0, 0
            if len(chunk):
                self.rows.appendList([tuple(r) for r in chunk.itertuples(index=False)])
                n += len(chunk)
                if not timer:
                    timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                    self.handle.registerTimer(timer)
        self.known.update((n, flushed, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, flushed, timer = self._state()
        if not n or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        held = self._held()
        self.rows.clear()
        self.known.update((0, flushed + 1, 0))
        yield self._batch(held, flushed + 1, BY_AGE)

    def close(self) -> None:
        pass


def flushed(stream: DataFrame, size: int, seconds: float, by: str | None = None) -> DataFrame:
    """The rows of a stream as they leave their buffers, with ``flush`` (the number of the batch, from 1 for each key), ``reason``
    (size or age) and ``flush_rows``.

    ``by`` names the column whose values have buffers of their own (null is one); without it there is one buffer. Ages pass only while
    the query runs: use a trigger with an interval.
    """
    if size < 1 or seconds <= 0:
        raise DataError("a buffer holds one row at least, for some time")
    clash = {"flush", "reason", "flush_rows", "_key"} & set(stream.columns)
    if clash:
        raise DataError(f"columns {sorted(clash)} are made by the buffers")
    use_state_store(stream.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), col(by).cast("string")), F.lit("-")) if by else F.lit("all")
    out = T.StructType([*stream.schema.fields, T.StructField("flush", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("flush_rows", T.LongType())])
    return stream.withColumn("_key", key).groupBy("_key").transformWithStateInPandas(
        _Buffer(stream.schema, size, seconds), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")
