"""Cleaning: duplicates, missing and infinite values, outliers, and small projections over labels and columns.

Operators that report counters return them as a one-row or long frame. A counter is computed when it is read, not before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BENIGN, LABEL_COLUMN
from ..core import (BROADCAST_BYTES, byte_size, col, count_when, fractional_columns, is_infinite, is_missing, numeric_columns, one_row,
                    pin, present, replace_columns)
from ..errors import DataError
from ..quantiles import hash_cuts, hash_order, quantile_row


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates. Spark combines copies before the shuffle, so a mass of copies of one row stays cheap."""
    return df.dropDuplicates()


def drop_duplicates_wide(df: DataFrame) -> DataFrame:
    """Whole-row duplicates of wide rows: only digests, and rows whose digest repeats, are shuffled.

    Two 64-bit hashes of each row are counted; the digests that occur more than once are held and their bytes summed. Up to
    ``BROADCAST_BYTES`` they are broadcast: rows with another digest can't repeat and stay where they are, the others are compared
    whole. Beyond that so many rows repeat that combining copies before the shuffle is the better way for all.
    """
    keys = [col(c) for c in df.columns]
    digest = {"_h": F.xxhash64(*keys), "_g": F.xxhash64(F.lit(7), *keys)}
    repeated = pin(df.select(*[v.alias(k) for k, v in digest.items()]).groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    if byte_size(repeated) > BROADCAST_BYTES:
        return drop_duplicates(df)
    marked = df.withColumns(digest).join(F.broadcast(repeated.withColumn("_again", F.lit(True))), ["_h", "_g"], "left")
    alone, again = (marked.filter(c).select(*keys) for c in (col("_again").isNull(), col("_again").isNotNull()))
    return alone.unionByName(again.dropDuplicates())


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and surplus copies."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(total.alias("rows"), F.count("n").alias("distinct_rows"), (total - F.count("n")).alias("duplicates"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, rows) in one pass over the table."""
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), count_when(is_missing(df, c)).alias("missing"),
                               F.count(F.lit(1)).alias("rows")) for c in columns])
    return df.agg(cells.alias("cells")).select(F.inline("cells"))


def missing_summary(df: DataFrame) -> DataFrame:
    return missing_counts(df).filter("missing > 0")


def mostly_missing(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Names of the columns whose missing share is above the threshold (one row of counts reaches the driver)."""
    over = missing_counts(df).filter(col("missing") > threshold * col("rows")).collect()
    return [r["column"] for r in over]


def fill_missing(df: DataFrame, value: float) -> DataFrame:
    """The constant goes into every missing cell; text columns take its text form."""
    return replace_columns(df, {f.name: F.coalesce(present(df, f.name), F.lit(value).cast(f.dataType))
                                for f in df.schema.fields
                                if isinstance(f.dataType, (T.NumericType, T.StringType))})


def handle_missing(df: DataFrame, strategy: str = "drop", threshold: float = 0.5, fill_value: float = 0.0) -> DataFrame:
    """``drop`` rows, ``fill`` a constant, or ``drop_columns`` that are mostly missing and then rows."""
    if strategy == "fill":
        return fill_missing(df, fill_value)
    if strategy == "drop_columns":
        return df.drop(*mostly_missing(df, threshold)).na.drop()
    if strategy == "drop":
        return df.na.drop()
    raise DataError(f"unknown strategy for missing values: {strategy}")


def replace_infinite(df: DataFrame, value: float | None = 0.0) -> DataFrame:
    return replace_columns(df, {c: F.when(is_infinite(col(c)), F.lit(value)).otherwise(col(c))
                                for c in fractional_columns(df)})


def infinite_counts(df: DataFrame) -> DataFrame:
    """(column, infinite) for the numeric columns that hold infinities."""
    names = numeric_columns(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), count_when(is_infinite(col(c))).alias("infinite"))
                      for c in names])
    return df.agg(cells.alias("cells")).select(F.inline("cells")).filter("infinite > 0")


def _clip_probs(percentile: float) -> tuple[float, float]:
    low = (100 - percentile) / 2
    return low / 100, (100 - low) / 100


def clip_bounds(df: DataFrame, percentile: float = 99.0, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, lower, upper, clipped) for the columns that have values outside the central share."""
    names = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    low, high = _clip_probs(percentile)
    fitted = one_row(quantile_row(df, names, [low, high]))
    bounded = df.select(*[present(df, c).alias(c) for c in names], fitted.alias("_q"))
    q = lambda c, p: F.col("_q").getField(f"{c}@{p}")
    counted = bounded.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.first(q(c, low)).alias("lower"), F.first(q(c, high)).alias("upper"),
        count_when((col(c) < q(c, low)) | (col(c) > q(c, high))).alias("clipped")) for c in names]).alias("cells"))
    return counted.select(F.inline("cells")).filter("clipped > 0")


def clip_outliers(df: DataFrame, percentile: float = 99.0, columns: Sequence[str] | None = None,
                  exact: bool = True) -> DataFrame:
    """Clip to the central share. A column without outliers is inside its bounds and comes out unchanged."""
    names = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    if not names:
        return df
    low, high = _clip_probs(percentile)
    fitted = one_row(quantile_row(df, names, [low, high], exact))
    q = lambda c, p: F.col("_q").getField(f"{c}@{p}")
    held = df.withColumn("_q", fitted)
    return replace_columns(held, {c: F.when(present(df, c).isNotNull(), F.greatest(F.least(
        present(df, c), q(c, high)), q(c, low))) for c in names}).drop("_q")


def clean(df: DataFrame, drop_dupes: bool = True, missing: str = "drop", infinite: bool = True, clip: bool = False,
          clip_percentile: float = 99.0) -> DataFrame:
    """Duplicates, then infinities, then missing values, then clipping."""
    out = drop_duplicates(df) if drop_dupes else df
    out = replace_infinite(out) if infinite else out
    out = handle_missing(out, missing)
    return clip_outliers(out, clip_percentile) if clip else out


def cleaning_report(df: DataFrame, missing: str = "drop") -> DataFrame:
    """One row of counters for :func:`clean` without clipping.

    Copies are counted, not removed: every distinct row carries its number of copies, so one shuffle serves all counters.
    """
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    nulls = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    infinite = [c for c in fractional_columns(df)]
    has_inf = sum((F.max(F.coalesce(is_infinite(col(c)), F.lit(False)).cast("int")) for c in infinite), F.lit(0))
    kept = count_when(nulls == 0) if missing == "drop" else F.count(F.lit(1))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("original_rows"),
        (F.coalesce(F.sum("_copies"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates_dropped"),
        F.coalesce(has_inf, F.lit(0)).cast("bigint").alias("infinite_columns"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls_before"),
        kept.alias("rows_after"),
        (F.coalesce(F.sum("_copies"), F.lit(0)) - kept).alias("rows_dropped"))


def minimal_clean(df: DataFrame) -> DataFrame:
    """All-null rows and columns out, infinities to NULL, then every row with a NULL out."""
    rows = df.na.drop("all")
    empty = [r["column"] for r in missing_counts(rows).filter("missing = rows").collect()]
    return replace_infinite(rows.drop(*empty), None).na.drop()


def exploration_clean(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """Blank text to NULL, unlabelled rows out, missing and infinite numbers to the median of the column.

    The median is taken twice, as published: first over the finite and infinite values for the missing cells, then over the
    rest for the infinite ones.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = replace_columns(df, {c: F.when(~F.col(f"`{c}`").rlike(r"^\s*$"), col(c)) for c in text})
    out = out.filter(col(label).isNotNull())
    lacking = {r["column"] for r in missing_summary(out).collect()}
    numbers = [c for c in numeric_columns(out) if c in lacking or c in fractional_columns(out)]

    def fill_median(frame: DataFrame) -> DataFrame:
        fitted = one_row(quantile_row(frame, numbers, [0.5]))
        held = frame.withColumn("_q", fitted)
        return replace_columns(held, {c: F.coalesce(present(frame, c), F.col("_q").getField(f"{c}@0.5"))
                                      for c in numbers}).drop("_q")

    return fill_median(replace_infinite(fill_median(out), None))


def align_to(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Others take the training columns in sorted order: extras out, absent ones as 0.0. The training frame stays."""
    names = sorted(train.columns)
    return [train, *[o.select(*[col(c) if c in o.columns else F.lit(0.0).alias(c) for c in names]) for o in others]]


def column_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, column) with side one of only_in_a, only_in_b, common."""
    ca, cb = set(a.columns), set(b.columns)
    rows = ([("only_in_a", c) for c in sorted(ca - cb)] + [("only_in_b", c) for c in sorted(cb - ca)]
            + [("common", c) for c in sorted(ca & cb)])
    return a.sparkSession.createDataFrame(rows, "side string, column string")


def coerced_features(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Everything but the excluded columns as double; what is not a number becomes 0."""
    return df.select(*[F.coalesce(F.nanvl(col(c).try_cast("double"), F.lit(None)), F.lit(0.0)).alias(c)
                       for c in df.columns if c not in set(exclude)])


def binary_label(label: Column, benign: str = BENIGN) -> Column:
    """0 for benign, 1 for anything else; a missing label is not benign."""
    return F.coalesce((F.trim(label) != benign).cast("int"), F.lit(1))


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows (all if fewer), chosen by the digest of the key: repeatable under any partitioning.

    Only digests are counted and compared; the rows themselves are filtered where they are.
    """
    keyed = df.withColumn("_digest", hash_order(key, seed))
    cut = hash_cuts(keyed, F.lit(0), col("_digest"), {"n": F.least(F.lit(n), col("rows"))})
    limit = one_row(cut.agg(F.max("digest").alias("digest")))
    return keyed.withColumn("_cut", limit).filter("_digest <= _cut.digest").drop("_digest", "_cut")
