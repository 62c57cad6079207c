"""Building blocks shared by every operator: column access, missing values, one-row statistics, the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DataError


def col(name: str) -> Column:
    """Column by its exact name; flow headers hold blanks, slashes and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, columns: Iterable[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise DataError(f"columns not found: {absent}; available: {df.columns}")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN where the type has one."""
    c = col(name)
    return (c.isNull() | F.isnan(c)) if name in fractional_columns(df) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN read as NULL, so that aggregates skip it."""
    c = col(name)
    return F.when(~F.isnan(c), c) if name in fractional_columns(df) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Read NaN as NULL once, right after the scan; infinities stay."""
    return replace_columns(df, {c: present(df, c) for c in fractional_columns(df)})


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def replace_columns(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """Replace (or append) many columns in one projection, keeping the order of the old ones."""
    kept = [changed[c].alias(c) if c in changed else col(c) for c in df.columns]
    added = [v.alias(c) for c, v in changed.items() if c not in df.columns]
    return df.select(*kept, *added)


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient with ``default`` where the divisor is zero or the result is undefined."""
    return F.coalesce(F.nanvl(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(None)),
                      F.lit(default))


def count_when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct column for use in any projection.

    Spark runs it once as a scalar subquery and puts the value into the generated code: no join, no driver round trip.
    """
    return stats.select(F.struct(*[col(c) for c in stats.columns]).alias("stats")).scalar()


def chain(pairs: Sequence[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """``CASE WHEN`` from (condition, value) pairs."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(pairs[0][0], lit(pairs[0][1]))
    for condition, value in pairs[1:]:
        out = out.when(condition, lit(value))
    return out.otherwise(lit(default))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only on a local master, as in tests, a folder of our own is made and set where that is unset.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise DataError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rillwatch-"))
        named = context.getCheckpointDir()
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the application ends."""
    parent = f"{shared_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{parent}/{name}"


def pin(df: DataFrame) -> DataFrame:
    """Fix a frame whose rows must not be computed twice with another outcome; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 32 << 20


def byte_size(df: DataFrame) -> int:
    """Bytes of all rows as Spark holds them: the lengths of texts, binaries and nested values, 16 for any other value."""
    width = F.lit(48)
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(col(c)), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(col(c)))), F.lit(0)) * 2
        else:
            width = width + 16
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join aggregates back onto the rows they came from.

    The aggregates are computed once, pinned, and their bytes summed. Up to ``BROADCAST_BYTES`` they are broadcast, so the
    large side is not shuffled and a hot key costs nothing; beyond that it is an ordinary join of two sides that are
    shuffled directly, where adaptive execution splits skew.
    """
    held = pin(stats)
    return df.join(F.broadcast(held) if byte_size(held) <= BROADCAST_BYTES else held, list(keys), how)
