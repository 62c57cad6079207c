"""Quantiles, modes and hash ranks of whole tables without collecting a column into one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import col, count_when, join_stats, one_row, present
from .ordering import add_running_totals

_ACCURACY = 10_000  # percentile_approx is at most n / accuracy ranks off
#: One column for all group keys: a struct equals another with nulls in the same places, a null key column equals nothing.
_BY = "_by"


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., column, value) without missing values."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), present(df, c).cast("double").alias("value"))
                      for c in columns])
    return (df.select(*[col(b) for b in by], F.explode(cells).alias("cell"))
            .select(*[col(b) for b in by], "cell.column", "cell.value").filter("value is not null"))


def _pick(counted: DataFrame, keys: list[str], sizes: DataFrame, probs: Column) -> DataFrame:
    """Linear-interpolated quantiles from (keys..., value, n).

    ``sizes`` holds per key the row count ``_rows`` and ``_skipped``, the number of rows below the first counted value.
    """
    running = add_running_totals(counted, [*keys, "value"], {"_through": "n"})
    first = running.groupBy(*keys).agg(F.min(col("_through") - col("n")).alias("_origin"))
    ranked = (join_stats(running, sizes.join(first, keys), keys, "inner")
              .withColumn("_from", col("_through") - col("n") - col("_origin") + col("_skipped"))
              .withColumn("_to", col("_from") + col("n")))
    at = lambda p: p * (col("_rows") - 1)
    covers = lambda rank: (rank >= col("_from")) & (rank < col("_to"))
    wanted = F.filter(probs, lambda p: covers(F.floor(at(p))) | covers(F.ceil(at(p))))
    hits = ranked.withColumn("prob", F.explode(wanted))
    low = F.max(F.when(covers(F.floor(at(col("prob")))), col("value"))).alias("_low")
    high = F.max(F.when(covers(F.ceil(at(col("prob")))), col("value"))).alias("_high")
    part = F.first(at(col("prob")) - F.floor(at(col("prob")))).alias("_part")
    found = hits.groupBy(*keys, "prob").agg(low, high, part)
    return found.select(*keys, "prob", F.when(
        col("_low").isNotNull() & col("_high").isNotNull(),
        col("_low") + F.when(col("_part") > 0, (col("_high") - col("_low")) * col("_part")).otherwise(0.0)
    ).otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).alias("quantile"))


def _bracketed(df: DataFrame, values: dict[str, Column], probs: Sequence[float], ends: dict[str, list[float] | None]) -> DataFrame:
    """(column, target, value, n, skipped), added up by task: the values inside the bracket of each rank and how often a batch holds them;
    and, with value null, how many values a task saw and how many of them lie below the bracket.

    ``ends`` are the lower ends of a column's brackets, then the upper ones. Done on Arrow batches: as Spark expressions, columns x ranks of
    them make code that is too large to compile.
    """
    names, many = list(values), len(probs)
    kinds = {"column": pa.string(), "target": pa.float64(), "value": pa.float64(), "n": pa.int64(), "skipped": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, below = dict.fromkeys(names, 0), {c: np.zeros(many, dtype=np.int64) for c in names}

        def made(parts: list[tuple]) -> pa.RecordBatch:
            column = lambda at, kind: pa.array(np.concatenate([p[at] for p in parts]), kind)
            size = [len(p[2]) for p in parts]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat([p[0] for p in parts], size).tolist(), pa.string()), pa.array(np.repeat([float(p[1]) for p in parts], size)),
                column(2, pa.float64()), column(3, pa.int64()), pa.array(np.zeros(sum(size), dtype=np.int64))], list(kinds))

        for batch in batches:
            parts = []
            for k, c in enumerate(names):
                if not ends[c]:
                    continue
                v = batch.column(f"c{k}").drop_null().to_numpy(zero_copy_only=False)
                v = np.sort(v) + 0.0  # one zero
                rows[c] += len(v)
                low, high = np.searchsorted(v, ends[c][:many], side="left"), np.searchsorted(v, ends[c][many:], side="right")
                below[c] += low
                for p, a, b in zip(probs, low, high):
                    if a < b:
                        parts.append((c, p, *np.unique(v[a:b], return_counts=True)))
            if parts:
                yield made(parts)
        cells = [(c, p, None, rows[c], int(b)) for c in names for p, b in zip(probs, below[c])]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*cells), kinds.values())], list(kinds))

    held = df.select(*[v.alias(f"c{k}") for k, v in enumerate(values.values())])
    return held.mapInArrow(run, "column string, target double, value double, n long, skipped long")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (by..., column, prob); null keys are a group.

    Without groups one pass brackets each wanted rank with ``percentile_approx`` (bounded state), and only the values inside
    the bracket - about 4 in 10,000 of a large table - are counted by value and ordered. With groups all distinct values are
    counted and ordered together, so a hot group is spread over the cluster.
    """
    probs = [float(p) for p in probs]
    values = {c: present(df, c).cast("double") for c in columns}
    if by:
        keys = [_BY, "column"]
        cells = _long(df.withColumn(_BY, F.struct(*[col(b) for b in by])), columns, [_BY])
        counted = cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
        sizes = counted.groupBy(*keys).agg(F.sum("n").alias("_rows")).withColumn("_skipped", F.lit(0))
        return _pick(counted, keys, sizes, F.array(*[F.lit(p) for p in probs])).select(f"{_BY}.*", "column", "prob", "quantile")

    # One row comes back: per column its count, and the digest around each rank, with half widths down to what the digest is inexact
    # by. The smallest one of two ranks or more makes the bracket.
    slacks = [2.0 / max(1, _ACCURACY // 10 ** k) for k in range(len(str(_ACCURACY)) - 1, -1, -1)]
    around = [min(1.0, max(0.0, p + side * slack)) for slack in slacks for side in (-1, 1) for p in probs]
    seen = df.agg(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, around, _ACCURACY).alias("at")).alias(c) for c, v in values.items()]).first()

    def ends(c: str) -> list[float] | None:
        step = sum(slack >= 2.0 / max(1, seen[c]["n"]) for slack in slacks[1:]) * 2 * len(probs)
        return seen[c]["at"][step:step + 2 * len(probs)] if seen[c]["at"] else None

    found = _bracketed(df, values, probs, {c: ends(c) for c in values})
    counted = found.filter("value is not null").groupBy("column", "target", "value").agg(F.sum("n").alias("n"))
    sizes = found.filter("value is null").groupBy("column", "target").agg(F.sum("n").alias("_rows"), F.sum("skipped").alias("_skipped"))
    return _pick(counted, ["column", "target"], sizes, F.array(col("target"))).drop("target")


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True) -> DataFrame:
    """All quantiles in one row, named ``{column}@{prob}``; ``exact=False`` takes ``percentile_approx`` instead."""
    if not columns:
        return df.sparkSession.range(1).select(F.lit(1).alias("none"))
    if not exact:
        return df.agg(*[F.percentile_approx(present(df, c), float(p), _ACCURACY).cast("double").alias(f"{c}@{p}")
                        for c in columns for p in probs])
    found = exact_quantiles(df, columns, probs)
    return found.agg(*[F.max(F.when((col("column") == c) & (col("prob") == float(p)), col("quantile")))
                       .alias(f"{c}@{p}") for c in columns for p in probs])


def floor_index_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Order statistics ``sorted[int(n * p)]``: one row per (by..., prob); null keys are a group."""
    keys = [_BY] if by else []
    cells = _long(df.withColumn(_BY, F.struct(*[col(b) for b in by])) if by else df, [column], keys)
    counted = cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    running = add_running_totals(counted, [*keys, "value"], {"_through": "n"})
    if keys:
        ends = running.groupBy(*keys).agg(F.min(col("_through") - col("n")).alias("_origin"),
                                          F.sum("n").alias("_rows"))
        ranked = join_stats(running, ends, keys, "inner")
    else:
        ends = one_row(running.agg(F.lit(0).alias("_origin"), F.sum("n").alias("_rows")))
        ranked = running.withColumn("_e", ends).select("*", "_e.*").drop("_e")
    start = col("_through") - col("n") - col("_origin")
    rank = lambda p: F.floor(p * col("_rows"))
    wanted = F.filter(F.array(*[F.lit(float(p)) for p in probs]),
                      lambda p: (rank(p) >= start) & (rank(p) < start + col("n")))
    return ranked.withColumn("prob", F.explode(wanted)).select(*([f"{_BY}.*"] if by else []), "prob", col("value").alias("quantile"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties, in one row: values are counted before they meet."""
    counted = _long(df, columns, []).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("column").agg(F.max(F.struct(col("n"), (-col("value")).alias("v"))).alias("top"))
    return best.agg(*[F.max(F.when(col("column") == c, -F.col("top.v"))).alias(c) for c in columns])


def hash_order(key: Sequence[str], seed: int) -> Column:
    """A repeatable pseudo-random order: 128-bit digest of the key, as hex text."""
    return F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))


def hash_cuts(df: DataFrame, group: Column, digest: Column, sizes: dict[str, Column], bits: int = 16) -> DataFrame:
    """Digest of the k-th row of each group in digest order, for several k at once.

    ``sizes`` maps a name to k as an expression over ``rows``, the size of the group. Rows are first counted in 2^bits
    digest ranges per group; only the one range a cut falls into is ranked row by row. Nothing but the digest is shuffled.
    """
    cell = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")
    if bits != 16:
        cell = F.shiftright(cell, 16 - bits)
    keyed = df.select(group.alias("group"), digest.alias("digest")).withColumn("cell", cell)
    counts = keyed.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^bits rows
    totals = counts.groupBy("group").agg(F.sum("n").alias("rows"))
    cum = (counts.withColumn("through", F.sum("n").over(along)).join(totals, "group")
           .withColumn("cut", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("k"))
                                                  for k, v in sizes.items()])))
           .select("group", "cell", "cut.name", "cut.k", (col("through") - col("n")).alias("ahead"), "through"))
    hit = cum.filter("k > ahead and k <= through").select("group", "cell", "name", (col("k") - col("ahead")).alias("nth"))
    local = Window.partitionBy("group", "name").orderBy("digest")
    return (join_stats(keyed, hit, ["group", "cell"], "inner")
            .withColumn("at", F.row_number().over(local)).filter("at = nth").select("group", "name", "digest"))
