"""Scans of labelled flow tables, and the load-and-label projections that follow them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BENIGN, FLOW_FEATURES, KNOWN_ATTACKS, RAW_LABEL_COLUMN
from ..core import col, nan_to_null, require
from ..errors import DataError

#: Schema of a raw flow file: the headers of the published files start with a blank.
RAW_FLOW_SCHEMA = T.StructType([T.StructField(f" {name}", T.DoubleType()) for name in FLOW_FEATURES]
                               + [T.StructField(RAW_LABEL_COLUMN, T.StringType())])


def _existing(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        raise DataError(f"file not found: {path}")
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header line. Give the schema: without one Spark reads the data twice."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(_existing(spark, path)))


def load_raw_flows(spark: SparkSession, path: str, schema: T.StructType | str | None = RAW_FLOW_SCHEMA) -> DataFrame:
    # enforceSchema=False binds fields by header name, so columns in another order are an error and not a mix-up.
    return read_csv(spark, path, schema, enforceSchema=False) if schema is not None else read_csv(spark, path)


def read_folders(spark: SparkSession, paths: Sequence[str], schemas: Sequence[T.StructType | str | None] | None = None
                 ) -> DataFrame:
    """Several folders or files as one table. Columns are matched by name, absent ones become NULL."""
    schemas = schemas or [None] * len(paths)
    return concat([strip_column_names(read_csv(spark, p, s)) for p, s in zip(paths, schemas)])


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def trim_labels(df: DataFrame, label: str) -> DataFrame:
    require(df, [label.strip()])
    return df.withColumn(label.strip(), F.trim(col(label.strip())))


def keep_known_labels(df: DataFrame, label: str, benign: str = BENIGN, attacks: Sequence[str] = KNOWN_ATTACKS) -> DataFrame:
    return df.filter(col(label.strip()).isin([benign, *attacks]))


def load_clean_flows(spark: SparkSession, path: str, label: str = RAW_LABEL_COLUMN,
                     schema: T.StructType | str | None = RAW_FLOW_SCHEMA) -> DataFrame:
    """Raw scan, blanks off the headers, labels trimmed, unknown labels out."""
    flows = trim_labels(strip_column_names(load_raw_flows(spark, path, schema)), label)
    return keep_known_labels(flows, label)


def split_features_and_label(df: DataFrame, label: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Features and label as two frames; both keep the key, for rows have no position."""
    require(df, [label, *key])
    return df.drop(label), df.select(*[col(k) for k in key], col(label))


def benign_only(df: DataFrame, label: str, benign: str = BENIGN) -> DataFrame:
    return df.filter(F.trim(col(label)) == benign).drop(label)


def select_configured(df: DataFrame, names: Sequence[str] = FLOW_FEATURES) -> DataFrame:
    """The configured features that exist, in configured order."""
    return df.select(*[col(c) for c in names if c in df.columns])


def write_splits(df: DataFrame, path: str) -> None:
    """One table with a folder per split: a read of one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(_existing(spark, path)).filter(col("split") == split).drop("split")


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
