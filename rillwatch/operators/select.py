"""Feature selection and tables of feature importance. Rankings have one row per feature, so they may be one window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..constants import KEEP_FEATURES, MAX_CORRELATION, MIN_VARIANCE
from ..core import col, numeric_columns, one_row, present
from ..quantiles import exact_quantiles, quantile_row
from .profile import correlation, correlation_pairs, top_by_variance, variance_table, variances


def by_variance(df: DataFrame, threshold: float = 0.0, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, variance) of the columns above the threshold."""
    return variance_table(df, columns).filter(col("variance") > threshold)


def by_correlation(df: DataFrame, target: str | None = None, threshold: float = 0.01,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """(column, r): largest absolute correlation, with the target or with any other feature, above the threshold."""
    names = list(columns or numeric_columns(df, exclude=[target] if target else []))
    if target:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(correlation(present(df, c), present(df, target))).alias("r"))
                          for c in names])
        return df.agg(cells.alias("cells")).select(F.inline("cells")).filter(col("r") > threshold)
    pairs = correlation_pairs(df, names)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("column"), F.abs("r").alias("r"))
    return sides.groupBy("column").agg(F.max("r").alias("r")).filter(col("r") > threshold)


def redundant(df: DataFrame, threshold: float = MAX_CORRELATION, columns: Sequence[str] | None = None) -> list[str]:
    """The later column of each pair above the threshold, in column order. Only p x p numbers are looked at."""
    names = list(columns or numeric_columns(df))
    late = {r["b"] for r in correlation_pairs(df, names).filter(F.abs("r") > threshold).select("b").distinct().collect()}
    return [c for c in names if c in late]


def drop_redundant(df: DataFrame, threshold: float = MAX_CORRELATION, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*redundant(df, threshold, columns))


def _counted(df: DataFrame, label: str, edges: dict[str, list[float]]) -> DataFrame:
    """(column, bin, label, n) of each task: a bin is the number of edges below the value, 0 where the value is missing."""
    names = list(edges)
    limits = [np.sort([e for e in edges[c] if e == e]) for c in names]  # nothing is above NaN
    kind = df.schema[label].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        bins = max(map(len, limits), default=0) + 1
        for batch in batches:
            coded = batch.column("label").dictionary_encode()
            classes = [*coded.dictionary.to_pylist(), None]
            code = pc.fill_null(coded.indices, len(classes) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, cuts in enumerate(limits):
                v = batch.column(f"c{k}")
                at = np.searchsorted(cuts, v.to_numpy(zero_copy_only=False), side="left")
                if v.null_count:
                    at[v.is_null().to_numpy(zero_copy_only=False)] = 0
                own = np.bincount(code * bins + at, minlength=len(classes) * bins).reshape(-1, bins)
                for i in np.flatnonzero(own.any(axis=1)):
                    if classes[i] not in sums:
                        sums[classes[i]] = np.zeros((len(names), bins), dtype=np.int64)
                    sums[classes[i]][k] += own[i]
        for value, own in sums.items():
            k, b = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in k], pa.string()), pa.array(b, pa.int32()),
                                              pa.array([value] * len(k), shape), pa.array(own[k, b], pa.int64())], ["column", "bin", "label", "n"])

    held = df.select(col(label).alias("label"), *[present(df, c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    shape = to_arrow_type(kind)
    return held.mapInArrow(run, T.StructType([T.StructField("column", T.StringType()), T.StructField("bin", T.IntegerType()),
                                              T.StructField("label", kind), T.StructField("n", T.LongType())]))


def mutual_information(df: DataFrame, label: str, columns: Sequence[str] | None = None, bins: int = 16) -> DataFrame:
    """(column, mi) in nats between each feature, cut into quantile bins, and the label.

    A binned estimate: values differ from a nearest-neighbour estimator, the ranking is what counts. Everything is counted
    as (column, bin, label) with a partial count on the map side.
    """
    names = list(columns or numeric_columns(df, exclude=[label]))
    probs = [i / bins for i in range(1, bins)]
    edges: dict[str, list[float]] = {c: [] for c in names}
    for r in exact_quantiles(df, names, probs).collect():  # bins - 1 numbers per column
        edges[r["column"]].append(float(r["quantile"]))
    counts = _counted(df, label, edges).groupBy("column", "bin", "label").agg(F.sum("n").alias("n"))
    by = lambda *k: Window.partitionBy(*k)  # at most bins x classes rows per column
    joint = counts.select("column", "n", F.sum("n").over(by("column")).alias("rows"),
                          F.sum("n").over(by("column", "bin")).alias("nb"), F.sum("n").over(by("column", "label")).alias("nl"))
    term = col("n") / col("rows") * F.log(col("n") * col("rows") / (col("nb") * col("nl")))
    return joint.groupBy("column").agg(F.sum(term).alias("mi"))


def top_features(df: DataFrame, label: str | None = None, n: int = KEEP_FEATURES, columns: Sequence[str] | None = None) -> list[str]:
    """Names of the n best columns, by mutual information with the label or by variance."""
    if label is None:
        return top_by_variance(df, n, columns)
    ranked = mutual_information(df, label, columns).orderBy(F.desc("mi"), "column").limit(n)
    return [r["column"] for r in ranked.collect()]


def select_features(df: DataFrame, label: str | None = None, columns: Sequence[str] | None = None, n: int = KEEP_FEATURES,
                    max_correlation: float = MAX_CORRELATION, min_variance: float = MIN_VARIANCE) -> list[str]:
    """Redundant columns out, then low variance, then the best n."""
    names = list(columns or numeric_columns(df, exclude=[label] if label else []))
    gone = set(redundant(df, max_correlation, names))
    kept = [c for c in names if c not in gone]
    spread = variances(df, kept)
    wide = [c for c in kept if (spread[c] or 0.0) > min_variance]
    kept = wide or kept
    return top_features(df, label, n, kept) if len(kept) > n else kept


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, correlation, abs_correlation, rank); an undefined correlation counts as 0."""
    names = list(columns or numeric_columns(df, exclude=[target]))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(
        correlation(present(df, c), present(df, target)), F.lit(0.0)).alias("correlation")) for c in names])
    found = df.agg(cells.alias("cells")).select(F.inline("cells"))
    return ranked(found.withColumn("abs_correlation", F.abs("correlation")), "abs_correlation")


def ranked(importance: DataFrame, value: str = "importance") -> DataFrame:
    """Adds rank 1..n, largest value first, names on ties."""
    return importance.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "feature")))


def top_k(importance: DataFrame, k: int = 10, value: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc(value), "feature").limit(k)


def importance_table(importance: DataFrame, n: int = 10) -> DataFrame:
    """Top n with a bar relative to the largest, rounded for display."""
    top = ranked(top_k(importance, n))
    largest = F.max("importance").over(Window.partitionBy())
    return top.select("rank", "feature", F.round("importance", 4).alias("importance"),
                      F.when(largest > 0, F.round(col("importance") / largest, 2)).otherwise(0.0).alias("bar"))


def important(importance: DataFrame, threshold: float = 0.01, at_least: int = 5, value: str = "importance") -> DataFrame:
    """Features at or above the threshold, and the first few in any case."""
    return ranked(importance, value).filter((col("rank") <= at_least) | (col(value) >= threshold))


def redundancy_summary(importance: DataFrame, threshold: float = 0.01) -> DataFrame:
    """One row: features above and below the threshold, and the share the first ten and twenty carry."""
    r = ranked(importance)
    return r.agg(F.count(F.lit(1)).alias("total_features"), F.count_if(col("importance") >= threshold).alias("important_features"),
                 F.count_if(col("importance") < threshold).alias("low_importance_features"),
                 F.sum(F.when(col("rank") <= 10, col("importance"))).alias("cumulative_importance_top_10"),
                 F.sum(F.when(col("rank") <= 20, col("importance"))).alias("cumulative_importance_top_20"))


def suggested(importance: DataFrame, n: int | None = None, percentile: float = 75.0) -> DataFrame:
    """The first n, or the features at or above a percentile of importance."""
    if n is not None:
        return ranked(importance).filter(col("rank") <= n)
    cut = one_row(quantile_row(importance, ["importance"], [percentile / 100]))
    return ranked(importance).filter(col("importance") >= cut.getField(f"importance@{percentile / 100}"))
