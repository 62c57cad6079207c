"""Pairwise moments of many columns in one Arrow pass.

A task adds up, for all pairs of columns, the rows where both are present, their sums and products, as matrix products of its
batches; values are taken relative to the first one seen, so that large offsets cost no digits and a constant column is exactly
constant. Each task sends its moments by blocks of columns; they are merged in two steps, first of neighbouring tasks, then of all. What
moves is a few numbers per pair and task, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import col

#: Columns in a block: a block of pairs has six numbers for each pair.
BLOCK = 128
#: Tasks whose moments are merged in the first step.
_TASKS = 32
_MOMENTS = "a int, b int, part long, moments binary"


class _Moments:
    """Of a block of pairs: rows where both are present, means of both over these, and their central products (xy, xx, yy)."""

    def __init__(self, values: np.ndarray):
        self.values = values  # (6, columns, columns)

    @staticmethod
    def of_sums(n, x, y, xy, xx, yy, x0, y0) -> _Moments:
        """From sums relative to the points ``x0`` and ``y0``."""
        safe = np.maximum(n, 1)
        return _Moments(np.stack([n, np.where(n > 0, x0 + x / safe, 0.0), np.where(n > 0, y0 + y / safe, 0.0),
                                  xy - x * y / safe, xx - x * x / safe, yy - y * y / safe]))

    def merged(self, other: _Moments) -> _Moments:
        n, mx, my, xy, xx, yy = self.values
        m, ox, oy, pxy, pxx, pyy = other.values
        total = n + m
        share = np.divide(m, total, out=np.zeros_like(n), where=total > 0)
        dx, dy = ox - mx, oy - my
        dx, dy = np.where(n * m > 0, dx, np.where(n > 0, 0.0, dx)), np.where(n * m > 0, dy, np.where(n > 0, 0.0, dy))
        weight = n * share
        return _Moments(np.stack([total, mx + dx * share, my + dy * share, xy + pxy + dx * dy * weight, xx + pxx + dx * dx * weight, yy + pyy + dy * dy * weight]))


def _merge(parts: Sequence[bytes], rows: int, columns: int) -> _Moments:
    out = None
    for part in parts:
        own = _Moments(np.frombuffer(part).reshape(6, rows, columns))
        out = own if out is None else out.merged(own)
    return out


def _task_moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = [col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]  # missing numbers come as NaN
    blocks = [range(a, min(a + BLOCK, len(names))) for a in range(0, len(names), BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero, sums = np.full(len(names), np.nan), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1).astype(np.float64)
            there = ~np.isnan(x)
            first = x[there.argmax(axis=0), np.arange(len(names))]
            zero = np.where(np.isnan(zero), first, zero)
            x = np.where(there, x - zero, 0.0)
            mask, square = there.astype(np.float64), x * x
            for i, a in enumerate(blocks):
                for j, b in enumerate(blocks[i:], i):
                    l, r = slice(a.start, a.stop), slice(b.start, b.stop)
                    own = np.stack([mask[:, l].T @ mask[:, r], x[:, l].T @ mask[:, r], mask[:, l].T @ x[:, r], x[:, l].T @ x[:, r],
                                    square[:, l].T @ mask[:, r], mask[:, l].T @ square[:, r]])
                    sums[i, j] = sums[i, j] + own if (i, j) in sums else own
        zero, part = np.nan_to_num(zero), TaskContext.get().partitionId()
        for (i, j), s in sums.items():
            made = _Moments.of_sums(*s, zero[blocks[i].start:blocks[i].stop][:, None], zero[blocks[j].start:blocks[j].stop][None, :])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int64()),
                                              pa.array([made.values.tobytes()], pa.binary())], ["a", "b", "part", "moments"])

    return df.select(*cells).mapInArrow(run, _MOMENTS)


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, mean_a, mean_b, c_ab, c_aa, c_bb) for every pair of columns, a before b: over the rows where both are present, ``c`` being
    sums of products of deviations. Without such rows n is 0."""
    names = list(columns)
    width = lambda k: min((k + 1) * BLOCK, len(names)) - k * BLOCK

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
        return pd.DataFrame({"a": [a], "b": [b], "part": [0], "moments": [_merge(rows["moments"], width(a), width(b)).values.tobytes()]})

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
        values = _merge(rows["moments"], width(a), width(b)).values
        i, j = np.meshgrid(np.arange(width(a)) + a * BLOCK, np.arange(width(b)) + b * BLOCK, indexing="ij")
        upper = i < j
        return pd.DataFrame({"i": i[upper], "j": j[upper], "n": values[0][upper].astype(np.int64),
                             **{c: v[upper] for c, v in zip(("mean_a", "mean_b", "c_ab", "c_aa", "c_bb"), values[1:])}})

    parts = _task_moments(df, names).withColumn("part", F.floor(col("part") / _TASKS))
    merged = parts.groupBy("a", "b", "part").applyInPandas(near, _MOMENTS).groupBy("a", "b").applyInPandas(
        last, "i int, j int, n long, mean_a double, mean_b double, c_ab double, c_aa double, c_bb double")
    every = df.sparkSession.range(len(names) ** 2).select(F.floor(col("id") / len(names)).cast("int").alias("i"), (col("id") % len(names)).cast("int").alias("j")).filter("i < j")
    listed = F.array(*[F.lit(c) for c in names])
    return every.join(merged, ["i", "j"], "left").select(
        F.element_at(listed, col("i") + 1).alias("a"), F.element_at(listed, col("j") + 1).alias("b"), F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "mean_a", "mean_b", "c_ab", "c_aa", "c_bb")


def column_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, variance): sample variances over the present values, added up on Arrow batches; null of fewer than two values."""
    names = list(columns)
    cells = [col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, square = (np.zeros(len(names)) for _ in range(3))
        for batch in batches:
            for i in range(len(names)):
                x = batch.column(f"c{i}").to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                with np.errstate(invalid="ignore", over="ignore"):
                    own = x[0] + (x - x[0]).mean()  # constant values have their own mean
                    apart, total = own - mean[i], count[i] + len(x)
                    square[i] += ((x - own) ** 2).sum() + (apart * apart * count[i] * len(x) / total if count[i] else 0.0)
                    mean[i] = mean[i] + apart * len(x) / total if count[i] else own
                count[i] = total
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(count), pa.array(mean), pa.array(square)], ["column", "n", "mean", "square"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        count = mean = square = 0.0
        for n, m, s in zip(parts["n"], parts["mean"], parts["square"]):
            if n:
                apart, total = m - mean, count + n
                square += s + (apart * apart * count * n / total if count else 0.0)
                mean = mean + apart * n / total if count else m
                count = total
        return pd.DataFrame({"column": [parts["column"].iloc[0]], "variance": [square / (count - 1) if count > 1 else None]}, dtype=object)

    return df.select(*cells).mapInArrow(run, "column string, n double, mean double, square double").groupBy("column").applyInPandas(
        merge, "column string, variance double")
