"""Global order without a one-task window.

``row_number().over(orderBy(...))`` and running sums without a partition key send every row to one task. Here the rows are
range-partitioned and sorted, the placement is pinned (a second run could cut the ranges elsewhere), and only the
per-partition totals - one row per partition - are accumulated. A value that holds a third of the rows is cut by the other
order columns, so no partition depends on one key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import col, join_stats, pin
from .errors import DataError

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row number below
_SLOT_MASK = (1 << _SLOT_BITS) - 1


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [col(o) if isinstance(o, str) else o for o in order]


def _placed(df: DataFrame, order: Sequence[str | Column], unkept: Sequence[str] = ()) -> DataFrame:
    by = _order(order)
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).drop(*unkept)
    rows = pin(rows.withColumn("_slot", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))


def _before(per_part: DataFrame, names: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions; the frame has one row per range partition."""
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_before_{n}") for n in names])


def add_position(df: DataFrame, order: Sequence[str | Column], name: str = "position", unkept: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row in the global order. One range shuffle, no second one. ``unkept`` columns only order the rows."""
    rows = _placed(df, order, unkept)
    offsets = _before(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), ["_n"])
    placed = rows.join(F.broadcast(offsets), "_part")  # one row per range partition
    return placed.select(*[col(c) for c in df.columns if c not in unkept],
                         (col("_before__n") + col("_slot").bitwiseAND(F.lit(_SLOT_MASK))).alias(name))


def add_group_position(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                       name: str = "position") -> DataFrame:
    """0-based position inside each group. A hot group is spread over many range partitions."""
    rows = add_position(df, [*group, *order], "_at")
    starts = rows.groupBy(*[col(g) for g in group]).agg(F.min("_at").alias("_start"))
    return (join_stats(rows, starts, group, "inner")
            .select(*[col(c) for c in df.columns], (col("_at") - col("_start")).alias(name)))


def add_running_totals(df: DataFrame, order: Sequence[str | Column], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums in the global order; ``totals`` maps the new column to the summed one, a number. Nulls add nothing.

    The one exchange of rows is the range partitioning. Each task then carries its sums through the sorted batches of its partition,
    from the total of all earlier ones on.
    """
    rows = _placed(df, order)
    sources = list(dict.fromkeys(totals.values()))
    types = {f.name: f.dataType for f in df.schema.fields}
    for s in sources:
        if not isinstance(types[s], (T.IntegralType, T.FloatType, T.DoubleType)):
            raise DataError(f"no running total of {s}: {types[s].simpleString()}")
    kinds = {s: T.LongType() if isinstance(types[s], T.IntegralType) else T.DoubleType() for s in sources}
    offsets = _before(rows.groupBy("_part").agg(*[F.sum(col(s)).alias(s) for s in sources]), sources)
    placed = rows.join(F.broadcast(offsets), "_part").select(  # one row per range partition
        *[col(c) for c in df.columns], *[F.coalesce(col(s), F.lit(0)).cast(kinds[s]).alias(f"_own_{i}") for i, s in enumerate(sources)],
        *[col(f"_before_{s}").cast(kinds[s]).alias(f"_from_{i}") for i, s in enumerate(sources)])
    width, wanted = len(df.columns), [sources.index(s) for s in totals.values()]
    names = [*df.columns, *totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(sources)
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = []
            for i in range(len(sources)):
                own = np.cumsum(batch.column(f"_own_{i}").to_numpy()) + carried[i]
                carried[i] = own[-1]
                sums.append(pa.array(own + batch.column(f"_from_{i}").to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *[sums[i] for i in wanted]], names)

    return placed.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, kinds[s]) for n, s in totals.items()]]))


def add_rolling(df: DataFrame, order: Sequence[str | Column], rows: int, features: dict[str, tuple[str, str]],
                partition_by: Sequence[str] = (), chunk_rows: int = 100_000) -> DataFrame:
    """Aggregates over the last ``rows`` rows, whole table or per entity.

    ``features`` maps the new name to (aggregate, column). The global order is cut into chunks of ``chunk_rows``; the last
    ``rows - 1`` rows of a chunk are copied into the next one, so every frame is complete inside one chunk and neither
    the whole table nor a hot entity is one window.
    """
    placed = add_position(df, [*partition_by, *order], "_at")
    chunk = F.floor(col("_at") / chunk_rows)
    spill = F.floor((col("_at") + (rows - 1)) / chunk_rows)
    copies = (placed.withColumn("_home", chunk)
              .withColumn("_chunk", F.explode(F.sequence(chunk, spill))))
    frame = (Window.partitionBy("_chunk", *[col(p) for p in partition_by]).orderBy("_at")
             .rowsBetween(-(rows - 1), 0))
    functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    made = [F.coalesce(functions[f](col(c)).over(frame), F.lit(0.0) if f == "std" else F.lit(None)).alias(new)
            for new, (f, c) in features.items()]
    return copies.select(*[col(c) for c in df.columns], "_home", "_chunk", *made).filter("_home = _chunk") \
        .drop("_home", "_chunk")
