"""File streams. A checkpoint remembers the files already read, so each is processed once across restarts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..core import col, nan_to_null
from ..errors import DataError

Schema = T.StructType | str


def _stream(spark: SparkSession, fmt: str, path: str, schema: Schema, files_per_trigger: int | None, pattern: str | None,
            columns: Sequence[str] | None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    return nan_to_null(rows.select(*[col(c) for c in columns]) if columns else rows)


def stream_csv(spark: SparkSession, path: str, schema: Schema, files_per_trigger: int | None = None,
               columns: Sequence[str] | None = None, pattern: str | None = None) -> DataFrame:
    return _stream(spark, "csv", path, schema, files_per_trigger, pattern, columns, header=True)


def stream_parquet(spark: SparkSession, path: str, schema: Schema, files_per_trigger: int | None = None,
                   columns: Sequence[str] | None = None, pattern: str | None = None) -> DataFrame:
    return _stream(spark, "parquet", path, schema, files_per_trigger, pattern, columns)


def stream_jsonl(spark: SparkSession, path: str, schema: Schema, files_per_trigger: int | None = None,
                 columns: Sequence[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Blank lines are ignored, lines that are not JSON are skipped."""
    return _stream(spark, "json", path, schema, files_per_trigger, pattern, columns, mode="DROPMALFORMED")


def watch_folder(spark: SparkSession, path: str, schema: Schema, pattern: str = "*.csv", files_per_trigger: int | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """New files of a folder, oldest first; the format follows the extension of the pattern."""
    readers = {".csv": stream_csv, ".parquet": stream_parquet, ".jsonl": stream_jsonl, ".json": stream_jsonl}
    for ending, reader in readers.items():
        if pattern.endswith(ending):
            return reader(spark, path, schema, files_per_trigger, columns, pattern)
    raise DataError(f"unsupported file format: {pattern}")
