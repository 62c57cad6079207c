"""Profiles of a labelled table: sizes, label shares, column statistics, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BENIGN, KNOWN_ATTACKS, MAX_CORRELATION
from ..core import col, count_when, is_missing, numeric_columns, one_row, present
from ..quantiles import exact_quantiles
from .clean import duplicate_count, missing_counts
from .gram import column_variances, pair_moments


def table_summary(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, columns, features, missing cells, surplus copies, classes and their imbalance."""
    sizes = one_row(missing_counts(df).agg(F.sum("missing").alias("total_missing")))
    copies = one_row(duplicate_count(df))
    per_label = df.groupBy(F.trim(col(label)).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("label is not null")
    return per_label.agg(F.count("n").alias("unique_labels"),
                         F.round(F.max("n") / F.min("n"), 2).alias("class_imbalance_ratio")).select(
        copies.getField("rows").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.lit(len(df.columns) - 1).alias("features"), sizes.getField("total_missing").alias("total_missing"),
        copies.getField("duplicates").alias("duplicates"), "unique_labels", "class_imbalance_ratio")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max) over the present values; std is the sample deviation."""
    names = list(columns or numeric_columns(df))
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(present(df, c)).alias("n"), F.avg(present(df, c)).alias("mean"),
        F.stddev_samp(present(df, c)).alias("std"), F.min(present(df, c)).cast("double").alias("min"),
        F.max(present(df, c)).cast("double").alias("max")) for c in names])
    moments = df.agg(cells.alias("cells")).select(F.inline("cells"))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75]).groupBy("column").agg(*[
        F.max(F.when(col("prob") == p, col("quantile"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return moments.join(quartiles, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def class_distribution(df: DataFrame, label: str, benign: str = BENIGN, attacks: Sequence[str] = KNOWN_ATTACKS) -> DataFrame:
    """(label, n, percentage, is_benign, is_known_attack)."""
    counts = df.groupBy(F.trim(col(label)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("rows"))).getField("rows")
    return counts.select("label", "n", F.round(col("n") / total * 100, 2).alias("percentage"),
                         (col("label") == benign).alias("is_benign"), col("label").isin(list(attacks)).alias("is_known_attack"))


def variances(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float | None]:
    """Sample variance by column: one number a column reaches the driver, which needs it to choose columns."""
    names = list(columns or numeric_columns(df))
    found = {r["column"]: r["variance"] for r in column_variances(df, names).collect()} if names else {}
    return {c: found.get(c) for c in names}


def top_by_variance(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> list[str]:
    found = variances(df, columns)
    return sorted(found, key=lambda c: (found[c] is None, -(found[c] or 0.0)))[:n]


def variance_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or numeric_columns(df))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.var_samp(present(df, c)).alias("variance")) for c in names])
    return df.agg(cells.alias("cells")).select(F.inline("cells"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson coefficient over the rows where both are present; NULL for a constant column (``corr`` would raise)."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, a before b, over the rows where both are present; NULL where one is constant there.

    One scan, in which tasks add up matrix products (:mod:`.gram`); only a few numbers per pair and task are shuffled.
    """
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    both = F.sqrt("c_aa") * F.sqrt("c_bb")
    r = F.when((col("c_aa") > 0) & (col("c_bb") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("c_ab", both))))
    return pair_moments(df, names).select("a", "b", r.alias("r"))


def correlation_matrix(df: DataFrame, max_features: int = 20) -> DataFrame:
    """(a, b, r) for all ordered pairs of the columns with the largest variance, the diagonal included."""
    names = numeric_columns(df)
    if len(names) > max_features:
        names = top_by_variance(df, max_features)
    half = correlation_pairs(df, names)
    spread = variance_table(df, names)
    diagonal = spread.select(col("column").alias("a"), col("column").alias("b"),
                             F.when(col("variance") > 0, F.lit(1.0)).alias("r"))
    return half.unionAll(half.select(col("b").alias("a"), col("a").alias("b"), "r")).unionAll(diagonal)


def highly_correlated(df: DataFrame, threshold: float = MAX_CORRELATION, max_features: int = 50) -> DataFrame:
    """(a, b, r): pairs whose absolute coefficient reaches the threshold, strongest first, rounded to four digits."""
    names = numeric_columns(df)
    if len(names) > max_features:
        names = top_by_variance(df, max_features)
    return (correlation_pairs(df, names).select("a", "b", F.abs("r").alias("r")).filter(col("r") >= threshold)
            .select("a", "b", F.round("r", 4).alias("r")).orderBy(F.desc("r"), "a", "b"))
