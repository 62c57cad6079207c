"""Derived features: ratios, differences, interactions, row statistics, logarithms, rolling and group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIRECTION_PAIRS
from ..core import col, join_stats, numeric_columns, one_row, present, ratio, replace_columns
from ..errors import DataError
from ..ordering import add_rolling
from .profile import top_by_variance


def ratio_features(df: DataFrame, numerators: Sequence[str] | None = None, denominators: Sequence[str] | None = None,
                   numeric: Sequence[str] | None = None) -> DataFrame:
    """``a__ratio__b`` for every numerator and denominator; 0 where the divisor is 0."""
    names = list(numeric or numeric_columns(df))
    tops = [c for c in (numerators or names[:5]) if c in df.columns]
    bottoms = [c for c in (denominators or names[-5:]) if c in df.columns]
    return replace_columns(df, {f"{a.strip()}__ratio__{b.strip()}": ratio(col(a), col(b))
                                for a in tops for b in bottoms if a != b})


def direction_ratios(df: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(DIRECTION_PAIRS)) -> DataFrame:
    return replace_columns(df, {f"{a}__ratio__{b}": ratio(col(a), col(b)) for a, b in pairs
                                if a in df.columns and b in df.columns})


def _near_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """Each name with the next two."""
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:i + 3]]


def difference_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``a__diff__b`` for each column and the next two."""
    names = list(columns or numeric_columns(df))
    return replace_columns(df, {f"{a.strip()}__diff__{b.strip()}": col(a) - col(b) for a, b in _near_pairs(names)
                                if a in df.columns and b in df.columns})


_OPERATIONS = {
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: ratio(a, b),
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
}


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None,
                         operations: Sequence[str] = ("multiply",), columns: Sequence[str] | None = None) -> DataFrame:
    """``a__op__b``; without pairs the ten columns of the largest variance are combined with their next two."""
    if pairs is None:
        pairs = _near_pairs(top_by_variance(df, 10, columns))
    return replace_columns(df, {f"{a.strip()}__{op}__{b.strip()}": _OPERATIONS[op](col(a), col(b))
                                for a, b in pairs if a in df.columns and b in df.columns
                                for op in operations if op in _OPERATIONS})


def row_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """row_mean, row_std (sample), row_max, row_min and row_median over the present numbers of a row."""
    names = list(columns or numeric_columns(df))
    held = df.withColumn("_row", F.sort_array(F.array_compact(F.array(*[present(df, c).cast("double") for c in names]))))
    row, n = F.col("_row"), F.size("_row")
    held = held.withColumn("_mean", F.try_divide(F.aggregate(row, F.lit(0.0), lambda s, x: s + x), n))
    spread = F.aggregate(row, F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    middle = F.when(n > 0, (F.get(row, F.floor((n - 1) / 2).cast("int")) + F.get(row, F.floor(n / 2).cast("int"))) / 2)
    return held.select(*[col(c) for c in df.columns], F.col("_mean").alias("row_mean"),
                       F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("row_std"),
                       F.get(row, (n - 1).cast("int")).alias("row_max"), F.get(row, F.lit(0)).alias("row_min"),
                       middle.alias("row_median"))


def log_features(df: DataFrame, columns: Sequence[str] | None = None, offset: float = 1.0) -> DataFrame:
    """``log1p`` after shifting a column with negative values up to zero."""
    names = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    lows = one_row(df.agg(*[F.min(present(df, c)).alias(c) for c in names]))
    held = df.withColumn("_low", lows)

    def moved(c: str) -> Column:
        low = F.col("_low").getField(c)
        shift = F.when(low < 0, F.abs(low) + offset).otherwise(F.lit(offset))
        return F.log1p(col(c) + shift - offset)

    return replace_columns(held, {c: moved(c) for c in names}).drop("_low")


def transform_features(df: DataFrame, interaction: bool = False, statistical: bool = False, ratios: bool = False,
                       logarithm: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """The wanted transformations in their fixed order; ``columns`` are the input features (the key is not one)."""
    base = list(columns or numeric_columns(df))
    made = lambda frame: base + [c for c in frame.columns if c not in df.columns]
    out = interaction_features(df, columns=base) if interaction else df
    out = row_statistics(out, made(out)) if statistical else out
    out = direction_ratios(out) if ratios else out
    return log_features(out, made(out)) if logarithm else out


def rolling_features(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, window_size: int = 5,
                     partition_by: Sequence[str] = ()) -> DataFrame:
    """``c__rmean``, ``c__rstd`` (0 for a single row), ``c__rmin`` and ``c__rmax`` over the last rows in the given order."""
    names = [c for c in (columns or numeric_columns(df, exclude=[*order, *partition_by])) if c in df.columns]
    wanted = {f"{c.strip()}__r{f}": (f, c) for c in names for f in ("mean", "std", "min", "max")}
    return add_rolling(df, order, window_size, wanted, partition_by)


def group_features(df: DataFrame, group: Sequence[str], columns: Sequence[str] | None = None,
                   functions: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Group aggregates joined back onto the rows as ``c__f__group``.

    Aggregated before the join, so a hot group is one row.
    """
    keys = [g for g in group if g in df.columns]
    names = [c for c in (columns or numeric_columns(df, exclude=group)) if c in df.columns]
    if not keys or not names:
        return df
    known = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    unknown = set(functions) - set(known)
    if unknown:
        raise DataError(f"unknown aggregate functions: {sorted(unknown)}")
    made = [(f"{c.strip()}__{f}__{'_'.join(keys)}", known[f](present(df, c))) for f in functions for c in names]
    stats = df.groupBy(*[col(k) for k in keys]).agg(*[value.alias(name) for name, value in made])
    return join_stats(df, stats, keys).select(*[col(c) for c in df.columns], *[col(name) for name, _ in made])
