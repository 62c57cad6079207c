"""Alert suppression over event time: cool-down per source, alerts per minute, actions per sliding minute.

These are sequential rules. They are cut so that no task folds a whole source or the whole table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ACTIONS_PER_MINUTE, ALERTS_PER_MINUTE, COOL_DOWN_SECONDS
from ..core import col, join_stats, pin
from ..errors import DataError
from ..ordering import add_running_totals


_BUCKET_ROWS = 50_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _groups(codes: np.ndarray) -> np.ndarray:
    """For sorted group codes: the end of the group of each row."""
    cuts = np.append(np.flatnonzero(np.diff(codes)) + 1, len(codes))
    return np.repeat(cuts, np.diff(np.append(0, cuts)))


def _after(code: np.ndarray, t: np.ndarray, wait: int, span: int) -> np.ndarray:
    """For rows sorted by (code, t) with 0 <= t < span: the first row of the same code at least ``wait`` later, or its end."""
    key = code.astype(np.int64) * (span + wait) + t
    return np.searchsorted(key, key + wait, side="left")


def _bucket(rows: int, *by: str) -> Column:
    """A bucket of about ``_BUCKET_ROWS`` rows: whole groups together, so that small groups share a Python call."""
    return F.pmod(F.xxhash64(*[col(b) for b in by]), F.lit(rows // _BUCKET_ROWS + 1)).alias("bucket")


def cool_down(df: DataFrame, source: str, ts: str, ident: str, seconds: float = COOL_DOWN_SECONDS,
              slice_seconds: float | None = None) -> DataFrame:
    """At most one row per source within ``seconds`` of the last row that was kept; ``ident`` is unique and breaks ties.

    What is kept depends on what was kept before, so a source is a chain through time. Time is cut into slices:

    1. per (source, slice), for every way the slice can begin - a first row within the cool-down from its start - the
       last row kept in it;
    2. per source, one small step per slice passes the last kept time on;
    3. per (source, slice), now knowing how it begins, the kept rows.

    Steps 1 and 3 spread a hot source over its slices; step 2 sees no rows, only slices.
    """
    wait = int(seconds * 1_000_000)
    width = int((slice_seconds or max(60 * seconds, 600)) * 1_000_000)
    if wait <= 0 or width < wait:
        raise DataError("the cool-down must be positive and not longer than a slice")
    # One row per source and instant: the smallest id stands for all of them.
    at = micros(col(ts))
    named = F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("-"))  # rows without a source are one source
    times = (df.select(named.alias("source"), at.alias("t"), col(ident).alias("ident"))
             .groupBy("source", "t").agg(F.min("ident").alias("ident")).withColumn("slice", F.floor(col("t") / width)))
    times = pin(times)

    def ways(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["source", "slice", "t"], ignore_index=True)
        code = bucket.groupby(["source", "slice"], sort=False).ngroup().to_numpy()
        t = bucket["t"].to_numpy() - bucket["slice"].to_numpy() * width
        end, after = _groups(code), _after(code, t, wait, width)
        last = np.where(after < end, after, np.arange(len(t)))
        while not np.array_equal(last[last], last):  # follow every chain to its end, doubling the step
            last = last[last]
        first = np.append(True, np.diff(code) > 0)
        entry = first | np.append(True, t[:-1] < wait)  # the first row, and each whose predecessor could still be too early
        ends = t[last]
        follows = np.append(entry[1:] & (code[1:] == code[:-1]), False)
        final = entry & ~(follows & np.append(ends[1:] == ends[:-1], False))  # neighbours that end alike are one
        out = bucket.loc[final, ["source", "slice"]]
        start = out["slice"].to_numpy() * width
        out = out.assign(upto=t[final] + start, ends=ends[final] + start)
        return out.groupby(["source", "slice"], sort=False).agg(list).reset_index()

    def carry(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["source", "slice"])
        of, kept, carried = None, None, []
        for source, upto, ends in zip(bucket["source"], bucket["upto"], bucket["ends"]):
            if source != of:
                of, kept = source, None
            carried.append(kept)
            i = 0 if kept is None else int(np.searchsorted(upto, kept + wait))
            if i < len(upto):
                kept = int(ends[i])
        return pd.DataFrame({"source": bucket["source"], "slice": bucket["slice"], "kept": pd.array(carried, dtype="Int64")})

    def keep(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["source", "slice", "t"], ignore_index=True)
        code = bucket.groupby(["source", "slice"], sort=False).ngroup().to_numpy()
        start = bucket["slice"].to_numpy() * width
        t = bucket["t"].to_numpy() - start
        end, after = _groups(code), _after(code, t, wait, width)
        earliest = (bucket["kept"] + wait).fillna(-1).to_numpy(dtype=np.int64) - start
        chosen = []
        for at in np.flatnonzero(np.append(True, np.diff(code) > 0)):
            stop = end[at]
            i = at + int(np.searchsorted(t[at:stop], earliest[at]))
            while i < stop:
                chosen.append(i)
                i = after[i]
        return bucket.iloc[chosen][["ident"]]

    n = times.count()
    table = pin(times.select("source", "slice", "t", _bucket(n, "source", "slice")).groupBy("bucket").applyInPandas(
        ways, "source string, slice long, upto array<long>, ends array<long>"))
    starts = table.withColumn("bucket", _bucket(table.count(), "source")).groupBy("bucket").applyInPandas(
        carry, "source string, slice long, kept long")
    kind = dict(df.dtypes)[ident]
    chosen = (times.join(starts, ["source", "slice"]).withColumn("bucket", _bucket(n, "source", "slice")).groupBy("bucket")
              .applyInPandas(keep, f"ident {kind}"))
    return df.join(chosen.withColumnRenamed("ident", ident), ident, "left_semi")


def per_minute_limit(df: DataFrame, ts: str, ident: str, limit: int = ALERTS_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """The first ``limit`` rows of each clock-aligned minute of event time.

    The rank is filtered right above the window, so Spark keeps only ``limit`` rows per minute and task before the
    shuffle (WindowGroupLimit): a minute that holds most of the rows reaches its task already thinned.
    """
    order = Window.partitionBy("_minute").orderBy(ts, ident)
    return (df.withColumn("_minute", F.floor(micros(col(ts)) / (seconds * 1_000_000)))
            .withColumn("_rank", F.row_number().over(order)).filter(col("_rank") <= limit).drop("_minute", "_rank"))


def anchored_minute_limit(df: DataFrame, ts: str, ident: str, limit: int = ALERTS_PER_MINUTE, seconds: float = 60,
                          start: str | None = None) -> DataFrame:
    """The first ``limit`` rows of each minute that starts at the first row more than ``seconds`` after the last start.

    The starts are what a cool-down over the whole stream keeps; a running count of them numbers the minutes. ``start`` names a
    further column for the start of a row's minute, in microseconds.
    """
    one = df.select(ident, ts).withColumn("_all", F.lit("all"))
    starts = cool_down(one, "_all", ts, ident, seconds + 1e-6).select(ident, F.lit(1).cast("bigint").alias("_start"))
    marked = df.join(starts, ident, "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    numbered = add_running_totals(marked, [ts, ident], {"_minute": "_start"})
    order = Window.partitionBy("_minute").orderBy(ts, ident)
    kept = numbered.withColumn("_rank", F.row_number().over(order)).filter(col("_rank") <= limit)
    if start:
        kept = kept.withColumn(start, F.min(micros(col(ts))).over(Window.partitionBy("_minute")))  # at most ``limit`` rows each
    return kept.drop("_start", "_minute", "_rank")


def alert_limits(df: DataFrame, source: str, ts: str, ident: str, seconds: float = COOL_DOWN_SECONDS,
                 limit: int = ALERTS_PER_MINUTE, minute_seconds: float = 60) -> DataFrame:
    """Cool-down first; only what passes it counts against the minute, which starts at its first alert.

    The second step sees at most one alert per source and cool-down, pinned between the two.
    """
    cooled = pin(cool_down(df, source, ts, ident, seconds))
    return anchored_minute_limit(cooled, ts, ident, limit, minute_seconds)


def action_limit(df: DataFrame, ts: str, ident: str, limit: int = ACTIONS_PER_MINUTE, seconds: int = 60,
                 by: Sequence[str] = (), before: DataFrame | None = None) -> DataFrame:
    """Adds ``executed``: fewer than ``limit`` executed actions in the last ``seconds`` of event time.

    Rows are counted by instant first, at most ``limit`` of each. After an idle clock interval no earlier action counts any more,
    so runs of busy intervals are independent. A run's instants pass through one task in order of time, batch by batch: it keeps
    the times of the last ``limit`` executed actions and searches, from each on, for the next instant that may have one, so memory
    does not grow with the run. ``before`` has what was executed earlier: (by..., t in microseconds, n). Pass ``by`` (for example
    the target) to limit each of many streams.
    """
    span = seconds * 1_000_000
    key = F.to_json(F.struct(*[col(k) for k in by]), {"ignoreNullFields": "false"}) if by else F.lit("")  # null keys are a stream
    rows = df.withColumns({"_by": key, "_t": micros(col(ts))})
    instants = rows.groupBy("_by", "_t").agg(F.least(F.count(F.lit(1)), F.lit(limit)).cast("int").alias("_n")).withColumn("_done", F.lit(0))
    if before is not None:
        instants = instants.unionByName(before.select(key.alias("_by"), col("t").alias("_t"), F.lit(0).alias("_n"), col("n").cast("int").alias("_done")))
    instants = pin(instants.withColumn("_cell", F.floor(col("_t") / span)))
    cells = instants.select("_by", "_cell").distinct()
    along = Window.partitionBy("_by").orderBy("_cell")  # one row per busy interval
    fresh = F.coalesce(col("_cell") - F.lag("_cell").over(along) > 1, F.lit(True)).cast("int")
    runs = cells.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(along)).drop("_new")
    dealt = join_stats(instants, runs, ["_by", "_cell"], "inner").select("_by", "_run", "_t", "_n", "_done")
    dealt = dealt.repartition("_by", "_run").sortWithinPartitions("_by", "_run", "_t", F.desc("_done"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, deque(maxlen=limit)
        for frame in frames:
            if not len(frame):
                continue
            who, run = frame["_by"].to_numpy(), frame["_run"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (run[1:] != run[:-1]), [True]]))
            taken = np.zeros(len(frame), dtype=np.int64)
            t, n, done = (frame[c].to_numpy() for c in ("_t", "_n", "_done"))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (who[a], run[a]) != last:
                    last = who[a], run[a]
                    recent.clear()
                _take(t[a:b], n[a:b], done[a:b], taken[a:b], recent, limit, span)
            yield frame.assign(_taken=taken)[taken > 0][["_by", "_t", "_taken"]]

    taken = dealt.mapInPandas(fold, "_by string, _t long, _taken long")
    same = Window.partitionBy("_by", "_t").orderBy(ident)
    first = rows.select("_by", "_t", ident, F.row_number().over(same).alias("_nth")).filter(col("_nth") <= limit)
    executed = first.join(taken, ["_by", "_t"]).filter(col("_nth") <= col("_taken")).select(ident).withColumn("executed", F.lit(True))
    return df.join(executed, ident, "left").withColumn("executed", F.coalesce("executed", F.lit(False)))


def _take(t: np.ndarray, n: np.ndarray, done: np.ndarray, taken: np.ndarray, recent: deque, limit: int, span: int) -> None:
    """Execute what may be: ``t`` ascending, ``n`` actions wanted and ``done`` ones executed earlier at each; fills ``taken``."""
    earlier, i = np.flatnonzero(done), 0
    while i < len(t):
        if done[i]:
            recent.extend([int(t[i])] * int(done[i]))
        else:
            while taken[i] < n[i] and (len(recent) < limit or recent[0] <= t[i] - span):
                recent.append(int(t[i]))
                taken[i] += 1
            if taken[i] < n[i]:  # full until the oldest leaves
                nxt = int(np.searchsorted(t, recent[0] + span))
                ahead = int(np.searchsorted(earlier, i + 1))
                i = min(nxt, int(earlier[ahead])) if ahead < len(earlier) else nxt
                continue
        i += 1
