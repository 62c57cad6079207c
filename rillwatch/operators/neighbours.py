"""Mutual information between a continuous feature and a class from nearest neighbours.

Ross: Mutual Information between Discrete and Continuous Data Sets (PLoS ONE 2014). For each value the distance to its k-th neighbour
within its class is found, and the values of all classes that are nearer are counted. All columns go through together: values are
range-sorted by (column, class, value) and cut into chunks that overlap by k rows, so neither a column nor a class is one task;
the counts come from running totals over the values and the interval ends in one sorted order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import col, join_stats, numeric_columns, pin, present, require
from ..errors import DataError
from ..ordering import add_position, add_running_totals

NEIGHBOURS = 3
_CHUNK = 1_000_000


def digamma(n: Column) -> Column:
    """Of a whole number of 1 or more: ten steps up, then the asymptotic series."""
    x = n.cast("double") + 10
    near = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return near - sum((1 / (n.cast("double") + i) for i in range(1, 10)), 1 / n.cast("double"))


def cells(df: DataFrame, label: str, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(column, class, value, id): values in units of their standard deviation, with a trace of noise from the key that parts ties.

    Rows without a label, and missing values, are left out; so are classes with one value in a column.
    """
    stats = df.agg(*[F.struct(F.stddev_pop(present(df, c).cast("double")).alias("sd"), F.avg(F.abs(present(df, c).cast("double"))).alias("size")).alias(f"s{i}")
                     for i, c in enumerate(columns)]).first()  # two numbers per column
    ident = F.xxhash64(*[col(k) for k in key])
    made = []
    for i, c in enumerate(columns):
        scale = stats[f"s{i}"]["sd"] or 1.0
        noise = F.shiftrightunsigned(F.xxhash64(F.lit(i), *[col(k) for k in key]), 11) / float(1 << 53) - 0.5
        value = present(df, c).cast("double") / scale + noise * (1e-10 * max(1.0, (stats[f"s{i}"]["size"] or 0.0) / scale))
        made.append(F.struct(F.lit(i).alias("column"), value.alias("value")))
    long = df.filter(col(label).isNotNull()).select(col(label).cast("string").alias("class"), ident.alias("id"), F.inline(F.array(*made))).filter("value IS NOT NULL")
    sizes = long.groupBy("column", "class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_stats(long, sizes, ["column", "class"], "inner").select("column", "class", "value", "id", "n")


def neighbour_information(df: DataFrame, label: str, key: Sequence[str], columns: Sequence[str] | None = None, k: int = NEIGHBOURS,
                          chunk_rows: int = _CHUNK) -> DataFrame:
    """(column, mi) in nats, 0 at least; ``key`` names the columns that tell rows apart. A column without two values of a class has 0."""
    names = list(columns or numeric_columns(df, exclude=[label, *key]))
    require(df, [label, *key, *names])
    if k < 1 or chunk_rows <= k:
        raise DataError("one neighbour at least, and chunks of more rows")
    points = pin(add_position(cells(df, label, names, key), ["column", "class", "value", "id"], "at"))
    spots = F.sequence(F.floor((col("at") - k) / chunk_rows), F.floor((col("at") + k) / chunk_rows))
    spread = points.withColumn("chunk", F.explode(spots))
    order = Window.partitionBy("chunk", "column", "class").orderBy("at")  # at most a chunk and k rows on either side
    value = col("value")
    below = [value] + [F.lag("value", j).over(order) for j in range(1, k + 1)]
    above = [value] + [F.lead("value", j).over(order) for j in range(1, k + 1)]
    wanted = F.least(F.lit(k), col("n") - 1)
    endless = F.lit(float("inf"))
    frame = spread.select("column", "class", "value", "id", "n", "at", "chunk", *[b.alias(f"b{j}") for j, b in enumerate(below)], *[a.alias(f"a{j}") for j, a in enumerate(above)])
    frame = frame.filter(col("chunk") == F.floor(col("at") / chunk_rows))  # each row in its own chunk, where its neighbours are

    def within(j: int, count: int) -> Column:
        """Half width of the interval that holds j neighbours below and ``count`` - j above."""
        return F.greatest(F.coalesce(value - col(f"b{j}"), endless), F.coalesce(col(f"a{count - j}") - value, endless))

    radius = F.lit(None).cast("double")
    for count in range(k, 0, -1):
        best = F.least(*[within(j, count) for j in range(count + 1)], endless)
        radius = F.when(wanted == count, best).otherwise(radius)
    near = frame.withColumn("radius", radius)
    # The neighbour itself is no nearer than itself: where it stands on a side, its value is the open end there.
    ends = lambda side, sign: F.coalesce(*[F.when(F.abs(col(f"{side}{j}") - value) == col("radius"), col(f"{side}{j}")) for j in range(1, k + 1)], value + sign * col("radius"))
    near = pin(near.select("column", "id", "n", wanted.alias("k"), "value", ends("b", -1).alias("low"), ends("a", 1).alias("high")))
    # Points at one value come behind the upper ends there and before the lower ends: counted are the points inside the open interval.
    marks = F.array(F.struct(col("high").alias("value"), F.lit(0).alias("kind")), F.struct(col("value"), F.lit(1).alias("kind")),
                    F.struct(col("low").alias("value"), F.lit(2).alias("kind")))
    line = near.select("column", "id", F.inline(marks)).withColumn("one", (col("kind") == 1).cast("long"))
    upto = add_running_totals(line, ["column", "value", "kind", "id"], {"upto": "one"})
    inside = upto.filter("kind <> 1").groupBy("column", "id").agg(F.sum(F.when(col("kind") == 0, col("upto")).otherwise(-col("upto"))).alias("m"))
    by_count = inside.groupBy("column", "m").agg(F.count(F.lit(1)).alias("times"))
    crowd = by_count.groupBy("column").agg(F.sum(digamma(F.greatest("m", F.lit(1))) * col("times")).alias("inside"), F.sum("times").alias("rows"))
    own = near.groupBy("column", "n", "k").agg(F.count(F.lit(1)).alias("times")).groupBy("column").agg(
        F.sum(digamma(col("k")) * col("times")).alias("k"), F.sum(digamma(col("n")) * col("times")).alias("n"))
    found = crowd.join(own, "column").select("column", (digamma(col("rows")) + (col("k") - col("n") - col("inside")) / col("rows")).alias("mi"))
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "column int, name string")
    return every.join(found, "column", "left").select(col("name").alias("column"), F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))
