"""Isolation forest: trees grown from small samples on the executors, scores by Arrow batches.

Liu, Ting, Zhou: Isolation Forest (ICDM 2008). MLlib has none. A tree needs at most ``max_samples`` rows, so growing one is a
small grouped task; the grown forest has at most trees x (2 x max_samples - 1) nodes whatever the size of the table. Trees of
more rows than a task holds, and forests too large for one small table, are grown and kept in Spark (``spread_forest``).
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FOREST_CONTAMINATION, FOREST_SAMPLE, FOREST_TREES, SEED, THRESHOLD_PERCENTILE
from ..core import col, is_infinite, join_stats, one_row, pin, present, require
from ..errors import DataError, ModelError
from ..functions.rules import severity_configured, threshold_confidence
from ..quantiles import quantile_row

_NODES = "tree int, node int, feature int, split double, left int, right int, path double"
_LARGEST_SAMPLE = 100_000  # rows of a tree that is grown in one task; trees of more are split over the table
_LARGEST_FOREST = 4_000_000  # nodes of a forest that is held as one small table; more stay in Spark


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows: 0, 1 and 2(ln(n-1) + g) - 2(n-1)/n."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big))


def _grow(tree: int, x: np.ndarray, usable: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Random splits until rows are alone, alike, or as deep as a balanced tree would be."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    rows, todo = [], [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, members, depth = todo.pop()
        part = x[members][:, usable]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(varying) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, depth + float(mean_path(len(members)))))
            continue
        pick = rng.choice(varying)
        split = rng.uniform(low[pick], high[pick])
        left = part[:, pick] <= split
        rows.append((tree, node, int(usable[pick]), float(split), made, made + 1, 0.0))
        todo += [(made, members[left], depth + 1), (made + 1, members[~left], depth + 1)]
        made += 2
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "path"])


def _compact(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arrays of a tree with the two children of a node side by side; a leaf is its own left child and never goes right."""
    nodes = {int(n.node): n for n in tree.itertuples()}
    order, depth, level = [0], 0, [0]
    children = {}
    while level:
        below = []
        for n in level:
            if nodes[n].feature >= 0:
                children[n] = len(order)
                order += [int(nodes[n].left), int(nodes[n].right)]
                below += order[-2:]
        depth += bool(below)
        level = below
    feature = np.array([max(nodes[n].feature, 0) for n in order], dtype=np.intp)
    split = np.array([nodes[n].split if nodes[n].feature >= 0 else np.inf for n in order])
    child = np.array([children.get(n, i) for i, n in enumerate(order)], dtype=np.intp)
    return feature, split, child, np.array([nodes[n].path for n in order]), depth


@dataclass(frozen=True)
class Forest:
    """A grown forest: the node table, the feature order and the fitted limits."""

    nodes: pd.DataFrame
    features: list[str]
    sample_size: int
    offset: float = -0.5
    threshold: float = 0.5
    stats: dict = field(default_factory=dict)

    def with_threshold(self, threshold: float) -> Forest:
        if not 0.0 <= threshold <= 1.0:
            raise ModelError(f"threshold {threshold} outside [0, 1]")
        return replace(self, threshold=float(threshold))

    # --- scoring ---

    def _raw(self) -> Callable[..., np.ndarray]:
        """Raw scores of a batch from its columns."""
        tables = [_compact(t) for _, t in self.nodes.groupby("tree", sort=True)]
        unit = float(mean_path(self.sample_size)) or 1.0

        def raw(*columns: pd.Series) -> np.ndarray:
            x = np.concatenate([c.to_numpy(dtype=float) for c in columns])  # column by column
            n = len(columns[0])
            row, total = np.arange(n), np.zeros(n)
            for offset, split, child, path, depth in tables:
                at = np.zeros(n, dtype=np.intp)
                for _ in range(depth):
                    at = child[at] + (x[offset[at] * n + row] > split[at])
                total += path[at]
            return -np.exp2(-(total / len(tables)) / unit)

        return raw

    def _inputs(self, df: DataFrame) -> list[Column]:
        require(df, self.features)
        return [F.coalesce(present(df, c).cast("double"), F.lit(0.0)) for c in self.features]

    def score_column(self, df: DataFrame) -> Column:
        """Raw score -2^(-E[path] / c(sample)); lower is more anomalous."""
        raw = self._raw()

        @F.pandas_udf("double")
        def scores(*columns: pd.Series) -> pd.Series:
            return pd.Series(raw(*columns))

        return scores(*self._inputs(df))

    def timed_score_column(self, df: DataFrame) -> Column:
        """Struct of the raw score and ``ms``, the time of the row's batch divided by its rows."""
        raw = self._raw()

        @F.pandas_udf("score double, ms double")
        def scores(*columns: pd.Series) -> pd.DataFrame:
            began = time.perf_counter()
            found = raw(*columns)
            return pd.DataFrame({"score": found, "ms": (time.perf_counter() - began) * 1000 / max(1, len(found))})

        return scores(*self._inputs(df))

    def score(self, df: DataFrame, name: str = "raw_score") -> DataFrame:
        return df.withColumn(name, self.score_column(df))

    def decide(self, df: DataFrame) -> DataFrame:
        """Adds raw_score, decision (score minus offset, negative for anomalies) and prediction (-1 or 1)."""
        scored = self.score(df).withColumn("decision", col("raw_score") - F.lit(self.offset))
        return scored.withColumn("prediction", F.when(col("decision") < 0, -1).otherwise(1))

    # --- storage ---

    def save(self, spark: SparkSession, path: str) -> None:
        """Node table as Parquet and one row of metadata."""
        spark.createDataFrame(self.nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"features": self.features, "sample_size": self.sample_size, "offset": self.offset,
                "threshold": self.threshold, "stats": self.stats}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return Forest(nodes.sort_values(["tree", "node"], ignore_index=True), **meta)


def sample_trees(df: DataFrame, features: Sequence[str], key: Sequence[str], rows: int, trees: int, sample: int,
                 seed: int) -> DataFrame:
    """(tree, _rank, features...): for each tree a little over ``sample`` rows in a repeatable random order.

    Every row draws from hashes of its key, so the samples do not depend on the partitioning. About four times the wanted
    rows are let through per tree, whatever the size of the table; the shuffle carries only these.
    """
    keys = [col(k) for k in key]
    unit = lambda h: F.shiftrightunsigned(h, 11) / float(1 << 53)  # hash to [0, 1)
    values = [F.coalesce(F.when(~is_infinite(present(df, c)), present(df, c).cast("double")), F.lit(0.0)).alias(f"_f{i}")
              for i, c in enumerate(features)]
    share = min(1.0, 4.0 * sample / rows)
    # How many trees draw a row is binomial, read off its hash; most rows of a large table have none and end here.
    lot = F.xxhash64(*keys, F.lit(seed))
    upto = _binomial_upto(trees, share)
    times = F.size(F.filter(F.array(*[F.lit(p) for p in upto]), lambda p: unit(col("_lot")) >= p))
    ranked_trees = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        F.xxhash64("_lot", t, F.lit(seed + 1)).alias("r"), t.alias("tree"))))
    some = (df.filter(unit(lot) >= upto[0]).select(*values, *[col(k).alias(f"_k{i}") for i, k in enumerate(key)], lot.alias("_lot"))
            .withColumn("_t", F.explode(F.slice(ranked_trees, F.lit(1), times))).withColumn("tree", F.col("_t.tree")))
    rank = F.xxhash64(*[col(f"_k{i}") for i in range(len(key))], col("tree"), F.lit(seed + 2))
    return some.select("tree", rank.alias("_rank"), *[col(f"_f{i}").alias(c) for i, c in enumerate(features)])


def _binomial_upto(n: int, p: float) -> list[float]:
    """Chances of at most 0, 1, ..., n - 1 successes in n draws."""
    if p >= 1.0:
        return [0.0] * n
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            for k in range(n)]
    return np.minimum(np.cumsum(np.exp(logs)), 1.0).tolist()


def fit(df: DataFrame, features: Sequence[str], key: Sequence[str], trees: int = FOREST_TREES,
        max_samples: int | float | str = "auto", contamination: float = FOREST_CONTAMINATION, max_features: float = 1.0,
        bootstrap: bool = False, seed: int = SEED, exact: bool = True) -> Forest:
    """Grow a forest; the offset is the ``contamination`` quantile of the training scores."""
    require(df, [*features, *key])
    rows = df.count()
    if rows == 0 or not features:
        raise ModelError("cannot train on an empty table")
    sample = (min(FOREST_SAMPLE, rows) if max_samples == "auto" else
              int(max_samples * rows) if isinstance(max_samples, float) else min(int(max_samples), rows))
    if sample < 1:
        raise ModelError(f"{sample} rows per tree")
    names, width = list(features), max(1, int(max_features * len(features)))
    stats = {"n_samples": rows, "n_features": len(names), "n_trees": trees, "contamination": contamination}
    if sample > _LARGEST_SAMPLE or trees * (2 * sample - 1) > _LARGEST_FOREST:
        from .spread_forest import fit_spread
        return _with_offset(replace(fit_spread(df, names, key, trees, sample, rows, width, bootstrap, seed), stats=stats), df, contamination, exact)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = group.sort_values("_rank")[names].to_numpy(dtype=float)[:sample]
        if bootstrap:
            x = x[rng.integers(0, len(x), size=len(x))]
        usable = np.sort(rng.choice(len(names), size=width, replace=False)) if width < len(names) else np.arange(len(names))
        return _grow(tree, x, usable, rng)

    drawn = sample_trees(df, names, key, rows, trees, sample, seed)
    nodes = drawn.groupBy("tree").applyInPandas(grow, _NODES).toPandas().sort_values(["tree", "node"], ignore_index=True)
    return _with_offset(Forest(nodes, names, sample, stats=stats), df, contamination, exact)


def _with_offset(grown: Forest, df: DataFrame, contamination: float, exact: bool) -> Forest:
    """The forest with its offset at the ``contamination`` quantile of the training scores."""
    scores = grown.score(df.select(*[col(c) for c in grown.features])).select("raw_score")
    cut = quantile_row(pin(scores) if exact else scores, ["raw_score"], [contamination], exact).first()[0]
    return replace(grown, offset=float(cut))


def normalise(df: DataFrame, score: str = "raw_score", by: Sequence[str] = (), name: str = "anomaly_score") -> DataFrame:
    """1 - (score - min) / range over the table or per group; 0 where all scores are equal."""
    ends = [F.min(score).alias("_lo"), F.max(score).alias("_hi")]
    if by:
        held = join_stats(df, df.groupBy(*[col(b) for b in by]).agg(*ends), by)
    else:
        held = df.withColumn("_e", one_row(df.agg(*ends))).select("*", "_e.*").drop("_e")
    spread = col("_hi") - col("_lo")
    return held.select(*[col(c) for c in df.columns], F.when(spread > 0, 1.0 - (col(score) - col("_lo")) / spread)
                       .otherwise(0.0).alias(name))


def predict_binary(df: DataFrame, forest: Forest, threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds anomaly_score and prediction: 1 where the normalised score reaches the threshold."""
    limit = forest.threshold if threshold is None else threshold
    return normalise(pin(forest.score(df)), by=by).withColumn("prediction", (col("anomaly_score") >= limit).cast("int"))


def train_detector(df: DataFrame, features: Sequence[str], key: Sequence[str], percentile: float = THRESHOLD_PERCENTILE,
                   exact: bool = True, **options) -> Forest:
    """Forest with the threshold at a percentile of the normalised training scores."""
    grown = fit(df, features, key, exact=exact, **options)
    scores = pin(grown.score(df.select(*[col(c) for c in features])).select("raw_score"))
    cut = quantile_row(normalise(scores), ["anomaly_score"], [percentile / 100], exact).first()[0]
    return grown.with_threshold(min(1.0, max(0.0, cut)))


def detect_anomalies(df: DataFrame, forest: Forest, threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds raw_score, anomaly_score, is_anomaly (above the threshold), severity and confidence.

    ``by`` normalises each batch on its own, as chunked scoring does; the default is the whole table. Rows are scored once
    and pinned, for the extremes and the rows both need the scores.
    """
    limit = forest.threshold if threshold is None else threshold
    scored = normalise(pin(forest.score(df)), by=by)
    hit = col("anomaly_score") > limit
    return scored.withColumns({"is_anomaly": hit, "severity": F.when(hit, severity_configured(col("anomaly_score"))).otherwise("low"),
                               "confidence": threshold_confidence(col("anomaly_score"), limit)})


def given_nodes(nodes: pd.DataFrame, features: Sequence[str], sample_size: int, **limits) -> Forest:
    """A forest from a node table made elsewhere (columns tree, node, feature, split, left, right, path)."""
    lacking = {"tree", "node", "feature", "split", "left", "right", "path"} - set(nodes.columns)
    if lacking:
        raise DataError(f"node table lacks {sorted(lacking)}")
    return Forest(nodes, list(features), sample_size, **limits)
