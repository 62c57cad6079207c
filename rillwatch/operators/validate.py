"""Checks of a table. Every check yields rows (level, check, subject, value); no rows of level 'error' means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BENIGN, FLOW_FEATURES, KNOWN_ATTACKS, LABEL_COLUMN
from ..core import col, count_when, is_infinite, is_missing, numeric_columns, present
from ..errors import DataError
from .clean import duplicate_count, missing_counts

_FINDING = "level string, check string, subject string, value double"


def _findings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _FINDING)


def check_structure(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """Empty table, repeated column names, label column absent."""
    spark = df.sparkSession
    if df.isEmpty():
        return _findings(spark, [("error", "empty", "", 0.0)])
    rows = [("error", "duplicate_column", c, float(df.columns.count(c))) for c in dict.fromkeys(df.columns)
            if df.columns.count(c) > 1]
    if label not in df.columns:
        rows.append(("error", "label_missing", label, 0.0))
    return _findings(spark, rows)


def label_sets(df: DataFrame, label: str, expected: Sequence[str]) -> DataFrame:
    """(side, label): labels that are unexpected, expected but absent, or shared."""
    found = df.select(F.trim(col(label)).alias("label")).distinct()
    wanted = df.sparkSession.createDataFrame([(x,) for x in expected], "label string")
    tag = lambda side, frame: frame.select(F.lit(side).alias("side"), "label")
    return (tag("unexpected", found.subtract(wanted)).unionAll(tag("absent", wanted.subtract(found)))
            .unionAll(tag("shared", found.intersect(wanted))))


def check_labels(df: DataFrame, label: str = LABEL_COLUMN, benign: str = BENIGN,
                 attacks: Sequence[str] = KNOWN_ATTACKS) -> DataFrame:
    """Unexpected labels and absent attacks warn, an absent benign label is an error; the distribution is information."""
    if label not in df.columns:
        return _findings(df.sparkSession, [("error", "label_missing", label, 0.0)])
    counts = df.groupBy(F.trim(col(label)).alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    wanted = df.sparkSession.createDataFrame([(x,) for x in [benign, *attacks]], "subject string")
    joined = counts.join(wanted.withColumn("wanted", F.lit(True)), "subject", "full")
    checked = joined.select("subject", F.coalesce("value", F.lit(0.0)).alias("value"), F.explode(F.array_compact(F.array(
        F.when(col("value").isNotNull(), F.struct(F.lit("info").alias("level"), F.lit("label_count").alias("check"))),
        F.when(col("wanted").isNull(), F.struct(F.lit("warning").alias("level"), F.lit("label_unexpected").alias("check"))),
        F.when(col("value").isNull(), F.when(
            col("subject") == benign, F.struct(F.lit("error").alias("level"), F.lit("benign_absent").alias("check")))
            .otherwise(F.struct(F.lit("warning").alias("level"), F.lit("attack_absent").alias("check"))))))).alias("f"))
    return checked.select(F.col("f.level"), F.col("f.check"), "subject", "value")


def check_features(df: DataFrame, required: Sequence[str] = FLOW_FEATURES) -> DataFrame:
    """Absent columns, missing share above 50 % (error) or 10 % (warning), infinite values: one pass."""
    wanted = [c.strip() for c in required]
    absent = _findings(df.sparkSession, [("error", "column_missing", c, 0.0) for c in wanted if c not in df.columns])
    share = lambda c: count_when(is_missing(df, c)) / F.count(F.lit(1)) * 100
    cells = [F.struct(F.lit("missing_share").alias("check"), F.lit(c).alias("subject"), share(c).alias("value"))
             for c in wanted if c in df.columns]
    cells += [F.struct(F.lit("infinite").alias("check"), F.lit(c).alias("subject"),
                       count_when(is_infinite(col(c))).cast("double").alias("value")) for c in numeric_columns(df)]
    if not cells:
        return absent
    level = (F.when((col("check") == "missing_share") & (col("value") > 50), "error")
             .when((col("check") == "missing_share") & (col("value") > 10), "warning")
             .when((col("check") == "infinite") & (col("value") > 0), "warning"))
    measured = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return absent.unionAll(measured.select(level.alias("level"), "check", "subject", "value").filter("level is not null"))


def check_quality(df: DataFrame) -> DataFrame:
    """Columns without any value (error); surplus copies above 30 % (error) or 5 % (warning)."""
    empty = missing_counts(df).filter("missing = rows and rows > 0").select(
        F.lit("error").alias("level"), F.lit("column_empty").alias("check"), col("column").alias("subject"),
        F.lit(100.0).alias("value"))
    share = F.try_divide(col("duplicates") * 100.0, col("rows"))
    copies = duplicate_count(df).select(
        F.when(share > 30, "error").when(share > 5, "warning").alias("level"), F.lit("duplicate_rows").alias("check"),
        F.lit("").alias("subject"), share.alias("value")).filter("level is not null")
    return empty.unionAll(copies)


def check_all(df: DataFrame, label: str = LABEL_COLUMN, features: bool = True, benign: str = BENIGN,
              attacks: Sequence[str] = KNOWN_ATTACKS, required: Sequence[str] = FLOW_FEATURES) -> DataFrame:
    """Structure first; only a sound structure is checked further."""
    structure = check_structure(df, label)
    if not structure.filter("level = 'error'").isEmpty():
        return structure
    out = structure.unionAll(check_labels(df, label, benign, attacks))
    if features:
        out = out.unionAll(check_features(df, required))
    return out.unionAll(check_quality(df))


def check_feature_schema(df: DataFrame, expected: Sequence[str] = FLOW_FEATURES) -> DataFrame:
    """Absent features (error), others (warning), not numeric (error), and the four counts (info)."""
    wanted, found = set(expected), set(df.columns)
    rows = [("error", "feature_missing", c, 0.0) for c in sorted(wanted - found)]
    rows += [("warning", "feature_extra", c, 0.0) for c in sorted(found - wanted)]
    rows += [("error", "not_numeric", f.name, 0.0) for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
    rows += [("info", name, "", float(n)) for name, n in (
        ("expected_count", len(expected)), ("actual_count", len(df.columns)),
        ("missing_count", len(wanted - found)), ("extra_count", len(found - wanted)))]
    return _findings(df.sparkSession, rows)


def check_feature_values(df: DataFrame, low: float = -1e10, high: float = 1e10) -> DataFrame:
    """Missing (warning), infinite (error), outside the expected range (warning)."""
    names = numeric_columns(df)
    cells = F.array(*[x for c in names for x in (
        F.struct(F.lit("warning").alias("level"), F.lit("missing").alias("check"), F.lit(c).alias("subject"),
                 count_when(is_missing(df, c)).cast("double").alias("value")),
        F.struct(F.lit("error").alias("level"), F.lit("infinite").alias("check"), F.lit(c).alias("subject"),
                 count_when(is_infinite(col(c))).cast("double").alias("value")),
        F.struct(F.lit("warning").alias("level"), F.lit("out_of_range").alias("check"), F.lit(c).alias("subject"),
                 count_when((present(df, c) < low) | (present(df, c) > high)).cast("double").alias("value")))])
    return df.agg(cells.alias("cells")).select(F.inline("cells")).filter("value > 0")


def require_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = (), name: str = "table") -> None:
    """Raise when a required column is absent, or (with optional names given) an unknown one is there."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise DataError(f"{name} lacks columns {absent}")
    extra = [c for c in df.columns if c not in {*required, *optional}] if optional else []
    if extra:
        raise DataError(f"{name} has unexpected columns {extra}")


def flawless(df: DataFrame) -> DataFrame:
    """The same rows; the query fails at the first missing or infinite value. No extra pass over the data."""
    flaw = F.lit(False)
    for c in df.columns:
        flaw = flaw | is_missing(df, c)
    for c in numeric_columns(df):
        flaw = flaw | F.coalesce(is_infinite(col(c)), F.lit(False))
    return df.filter(F.when(flaw, F.raise_error(F.lit("missing or infinite value")).cast("boolean")).otherwise(True))
