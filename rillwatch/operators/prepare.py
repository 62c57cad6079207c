"""Fitted preparation: imputing, encoding, scaling, splitting.

A fitted statistic is a one-row frame. It can be written, read back and applied to any other frame; applying it is a
projection over a scalar subquery, so fitting and applying stay one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import SEED, TEST_SIZE, VAL_SIZE
from ..core import col, is_infinite, join_stats, numeric_columns, one_row, present, replace_columns
from ..errors import DataError
from ..quantiles import hash_cuts, hash_order, modes, quantile_row
from . import clean as cleaning

STRATEGIES = ("mean", "median", "most_frequent", "constant", "drop")


# --- imputing -------------------------------------------------------------------------------------------------------

def fit_imputer(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "mean",
                fill_value: float = 0.0) -> DataFrame:
    """One row with the fill value of each column."""
    if strategy not in STRATEGIES or strategy == "drop":
        raise DataError(f"no imputer for strategy '{strategy}'")
    names = list(columns or numeric_columns(df))
    if strategy == "constant":
        return df.agg(*[F.any_value(F.lit(fill_value)).alias(c) for c in names])
    if strategy == "mean":
        return df.agg(*[F.avg(present(df, c)).alias(c) for c in names])
    if strategy == "median":
        medians = quantile_row(df, names, [0.5])
        return medians.select(*[col(f"{c}@0.5").alias(c) for c in names])
    return modes(df, names)


def apply_imputer(df: DataFrame, fitted: DataFrame) -> DataFrame:
    names = [c for c in fitted.columns if c in df.columns]
    held = df.withColumn("_fill", one_row(fitted))
    return replace_columns(held, {c: F.coalesce(present(df, c).cast("double"), F.col("_fill").getField(c).cast("double"))
                                  for c in names}).drop("_fill")


def impute(df: DataFrame, strategy: str = "mean", fill_value: float = 0.0, columns: Sequence[str] | None = None,
           threshold: float = 0.5) -> DataFrame:
    """Columns that are mostly missing out, then the missing numbers filled (or, with ``drop``, their rows out)."""
    if strategy not in STRATEGIES:
        raise DataError(f"unknown imputation strategy '{strategy}'; one of {STRATEGIES}")
    counts = {r["column"]: r for r in cleaning.missing_counts(df).collect()}
    if counts and next(iter(counts.values()))["rows"] == 0:
        raise DataError("cannot impute an empty table")
    gone = [c for c, r in counts.items() if r["missing"] > threshold * r["rows"]]
    kept = df.drop(*gone)
    if strategy == "drop":
        return kept.na.drop()
    wanted = columns if columns is not None else numeric_columns(kept)
    lacking = [c for c in wanted if c in kept.columns and counts[c]["missing"] > 0]
    return apply_imputer(kept, fit_imputer(kept, lacking, strategy, fill_value)) if lacking else kept


# --- labels ---------------------------------------------------------------------------------------------------------

def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code) with codes in alphabetical order; as many rows as there are classes."""
    distinct = df.select(F.trim(col(label)).alias("label")).distinct()
    return distinct.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))


def fit_label_indexer(df: DataFrame, label: str, code: str) -> StringIndexerModel:
    """Labels are trimmed. Null and unseen labels are errors, as they are for the published encoder."""
    trimmed = df.withColumn(label, F.trim(col(label).cast("string")))
    return StringIndexer(inputCol=label, outputCol=code, stringOrderType="alphabetAsc", handleInvalid="error").fit(trimmed)


def encode_labels(df: DataFrame, label: str, code: str, fitted: StringIndexerModel | None = None) -> DataFrame:
    model = fitted or fit_label_indexer(df, label, code)
    return model.transform(df.withColumn(label, F.trim(col(label).cast("string")))).withColumn(code, col(code).cast("int"))


def decode_labels(df: DataFrame, code: str, label: str, fitted: StringIndexerModel) -> DataFrame:
    return IndexToString(inputCol=code, outputCol=label, labels=fitted.labels).transform(
        df.withColumn(code, col(code).cast("double"))).withColumn(code, col(code).cast("int"))


# --- scaling --------------------------------------------------------------------------------------------------------

def _finite(df: DataFrame, name: str) -> Column:
    c = present(df, name).cast("double")
    return F.coalesce(F.when(~is_infinite(c), c), F.lit(0.0))


def fit_scaler(df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """One row with ``{column}@center`` and ``{column}@scale``.

    standard: mean and population deviation; minmax: minimum and range; robust: median and inter-quartile range. A scale
    of zero divides by one.
    """
    names = list(columns or numeric_columns(df))
    solid = df.select(*[_finite(df, c).alias(c) for c in names])
    unit = lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)
    if method == "standard":
        stats = [(c, F.avg(col(c)), F.stddev_pop(col(c))) for c in names]
    elif method == "minmax":
        stats = [(c, F.min(col(c)), F.max(col(c)) - F.min(col(c))) for c in names]
    elif method == "robust":
        row = quantile_row(solid, names, [0.25, 0.5, 0.75])
        return row.select(*[x for c in names for x in (
            col(f"{c}@0.5").alias(f"{c}@center"),
            unit(col(f"{c}@0.75") - col(f"{c}@0.25")).alias(f"{c}@scale"))])
    else:
        raise DataError(f"unknown scaling method '{method}'; one of standard, minmax, robust")
    return solid.agg(*[x for c, center, scale in stats
                       for x in (center.alias(f"{c}@center"), unit(scale).alias(f"{c}@scale"))])


def _scaled_columns(fitted: DataFrame) -> list[str]:
    return [c.removesuffix("@center") for c in fitted.columns if c.endswith("@center")]


def scale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    names = [c for c in _scaled_columns(fitted) if c in df.columns]
    held = df.withColumn("_s", one_row(fitted))
    return replace_columns(held, {c: (_finite(df, c) - F.col("_s").getField(f"{c}@center"))
                                  / F.col("_s").getField(f"{c}@scale") for c in names}).drop("_s")


def unscale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    names = [c for c in _scaled_columns(fitted) if c in df.columns]
    held = df.withColumn("_s", one_row(fitted))
    return replace_columns(held, {c: col(c) * F.col("_s").getField(f"{c}@scale")
                                  + F.col("_s").getField(f"{c}@center") for c in names}).drop("_s")


# --- storage --------------------------------------------------------------------------------------------------------

def save_fitted(fitted: DataFrame, path: str) -> None:
    """A fitted imputer or scaler is one row."""
    fitted.coalesce(1).write.mode("overwrite").parquet(path)


def load_fitted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_label_indexer(fitted: StringIndexerModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load_label_indexer(path: str) -> StringIndexerModel:
    return StringIndexerModel.load(path)


# --- splitting ------------------------------------------------------------------------------------------------------

def add_split(df: DataFrame, key: Sequence[str], label: str | None, test_size: float = TEST_SIZE,
              val_size: float = VAL_SIZE, seed: int = SEED) -> DataFrame:
    """Column ``split`` (train, val, test), exact within each label (or over the table when ``label`` is None).

    Of the n rows of a label, ceil(n * test_size) go to test and ceil(rest * val_size / (1 - test_size)) to val, in the
    order of the key's digest. The cut digests are found from counts; the wide rows are never shuffled or sorted.
    """
    if test_size + val_size >= 1.0:
        raise DataError(f"test_size ({test_size}) + val_size ({val_size}) must be below 1")
    group = F.coalesce(F.concat(F.lit("="), F.trim(col(label))), F.lit("-")) if label else F.lit("all")  # no label is a label
    keyed = df.withColumn("_digest", hash_order(key, seed)).withColumn("_group", group)
    n_test = F.ceil(F.round(col("rows") * test_size, 9))
    n_val = F.ceil(F.round((col("rows") - n_test) * (val_size / (1 - test_size)), 9))
    cuts = hash_cuts(keyed, col("_group"), col("_digest"), {"test": n_test, "val": n_test + n_val})
    by_group = cuts.groupBy(col("group").alias("_group")).agg(  # one row per class
        F.max(F.when(col("name") == "test", col("digest"))).alias("_test"),
        F.max(F.when(col("name") == "val", col("digest"))).alias("_val"))
    placed = join_stats(keyed, by_group, ["_group"])
    split = (F.when(col("_digest") <= col("_test"), "test").when(col("_digest") <= col("_val"), "val")
             .otherwise("train"))
    return placed.select(*[col(c) for c in df.columns], split.alias("split"))


def split_sizes(df: DataFrame, expected: dict[str, float] | None = None, tolerance: float = 0.02) -> DataFrame:
    """(split, n, share, expected, ok): the val and test shares against the wanted ones."""
    expected = expected or {"test": TEST_SIZE, "val": VAL_SIZE}
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("rows")))
    want = F.coalesce(*[F.when(col("split") == k, F.lit(v)) for k, v in expected.items()])
    return (counts.select("split", "n", (col("n") / total.getField("rows")).alias("share"), want.alias("expected"))
            .withColumn("ok", F.coalesce(F.abs(col("share") - col("expected")) <= tolerance, F.lit(True))))


def split_class_shares(df: DataFrame, label: str, tolerance: float = 0.05) -> DataFrame:
    """(label, train_share, val_share, test_share, ok) for the classes of the training split."""
    names = ["train", "val", "test"]
    counts = df.groupBy(F.trim(col(label)).alias("label")).agg(
        *[F.count_if(col("split") == s).alias(s) for s in names])  # one row per class
    totals = one_row(counts.agg(*[F.sum(s).alias(s) for s in names]))
    shares = counts.filter("train > 0").select("label", *[
        F.coalesce(F.try_divide(col(s), totals.getField(s)), F.lit(0.0)).alias(f"{s}_share") for s in names])
    return shares.withColumn("ok", (F.abs(col("val_share") - col("train_share")) <= tolerance)
                             & (F.abs(col("test_share") - col("train_share")) <= tolerance))
