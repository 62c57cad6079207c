"""Suppression on unbounded streams: state per source or per minute, kept until the watermark has passed it.

Rows behind the watermark are dropped by Spark. Within a micro-batch rows are taken in (event time, id) order; on input that
arrives in order the result equals the batch operators in :mod:`rillwatch.operators.limits`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import ALERTS_PER_MINUTE, COOL_DOWN_SECONDS
from ..core import col


def _ordered(chunks: Iterator[pd.DataFrame], ts: str, ident: str) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values([ts, ident], ignore_index=True)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def cool_down_stream(df: DataFrame, source: str, ts: str, ident: str, seconds: float = COOL_DOWN_SECONDS,
                     watermark: str = "1 minute") -> DataFrame:
    """At most one row per source within ``seconds`` of the last kept one; a source's state ends with its cool-down."""
    names = df.columns
    wait_ms = int(seconds * 1000)

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(chunks, ts, ident)
        kept = state.get[0] if state.exists else None
        times, chosen = rows[ts].astype("datetime64[us]").astype("int64").to_numpy(), []
        i = 0 if kept is None else int(np.searchsorted(times, kept + wait_ms * 1000))
        while i < len(times):  # from one kept row to the next
            kept = int(times[i])
            chosen.append(i)
            i = int(np.searchsorted(times, kept + wait_ms * 1000))
        state.update((kept,))
        state.setTimeoutTimestamp(max(kept // 1000 + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[chosen][names]

    return df.withWatermark(ts, watermark).groupBy(col(source)).applyInPandasWithState(
        fold, _schema(df), "kept long", "append", GroupStateTimeout.EventTimeTimeout)


def per_minute_limit_stream(df: DataFrame, ts: str, ident: str, limit: int = ALERTS_PER_MINUTE, seconds: int = 60,
                            watermark: str = "1 minute") -> DataFrame:
    """The first ``limit`` rows of each clock-aligned minute; the counter of a minute ends when the watermark passes it."""
    names = df.columns
    span_ms = seconds * 1000

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        # Only the first rows of the batch can matter, so earlier chunks are thinned as they come.
        rows = None
        for chunk in chunks:
            both = chunk if rows is None else pd.concat([rows, chunk], ignore_index=True)
            rows = both.sort_values([ts, ident], ignore_index=True).head(max(limit - used, 0))
        state.update((used + len(rows),))
        state.setTimeoutTimestamp(max((int(key[0]) + 1) * span_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[names]

    minute = F.floor(F.unix_millis(col(ts)) / span_ms)
    return df.withWatermark(ts, watermark).withColumn("_minute", minute).groupBy("_minute").applyInPandasWithState(
        fold, _schema(df), "used int", "append", GroupStateTimeout.EventTimeTimeout)
