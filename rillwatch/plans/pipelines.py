"""Whole jobs composed of operators: preparing a table or its splits, engineering features, reporting on models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BENIGN, KEEP_FEATURES, LABEL_COLUMN, MAX_CORRELATION, MIN_VARIANCE
from ..core import col, is_missing, numeric_columns, pin
from ..errors import DataError
from ..operators import clean, features, forest, metrics, prepare, select
from ..operators.classify import Classifier


@dataclass
class Prepared:
    """The prepared table and everything fitted on the way."""

    table: DataFrame
    features: list[str]
    indexer: StringIndexerModel | None = None
    scaler: DataFrame | None = None
    steps: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def prepare_table(df: DataFrame, label: str = LABEL_COLUMN, columns: Sequence[str] | None = None, cleaning: bool = True,
                  imputing: bool = True, encoding: bool = True, scaling: bool = True, missing: str = "drop",
                  strategy: str = "mean") -> Prepared:
    """Clean, impute, encode the label, scale. A step that cannot run is recorded and skipped.

    With ``missing='drop'``, the default, no missing value is left to impute; pass ``missing='keep'`` to impute instead.
    """
    out = Prepared(df, [])

    def step(name: str, wanted: bool, run) -> None:
        if not wanted:
            return
        try:
            run()
            out.steps.append(name)
        except DataError as error:
            out.errors.append(f"{name}: {error}")

    def do_clean() -> None:
        out.table = clean.replace_infinite(clean.drop_duplicates(df)) if missing == "keep" else clean.clean(df, missing=missing)

    def do_impute() -> None:
        out.table = prepare.impute(out.table, strategy)

    def do_encode() -> None:
        out.indexer = prepare.fit_label_indexer(out.table, label, "_code")
        out.table = prepare.encode_labels(out.table, label, "_code", out.indexer).drop(label).withColumnRenamed("_code", label)

    def do_scale() -> None:
        out.scaler = prepare.fit_scaler(out.table, out.features)
        out.table = prepare.scale(out.table, out.scaler)

    step("clean", cleaning, do_clean)
    step("impute", imputing, do_impute)
    out.features = list(columns or numeric_columns(out.table, exclude=[label]))
    step("encode", encoding and label in out.table.columns, do_encode)
    step("scale", scaling and bool(out.features), do_scale)
    return out


def prepare_splits(df: DataFrame, label: str = LABEL_COLUMN, columns: Sequence[str] | None = None,
                   strategy: str = "mean") -> Prepared:
    """The same for a table with a ``split`` column: encoder and scaler fitted on train, cleaning and imputing per split."""
    cleaned = pin(clean.clean(df))  # the split is part of the row, so copies are dropped inside a split; each split is read twice
    parts = []
    for name in ("train", "val", "test"):
        rows = cleaned.filter(col("split") == name)
        lacking = [c for c in numeric_columns(df, exclude=[label])]
        parts.append(prepare.apply_imputer(rows, prepare.fit_imputer(rows, lacking, strategy)))
    table = reduce(DataFrame.unionByName, parts)
    train = table.filter(col("split") == "train")
    names = list(columns or numeric_columns(table, exclude=[label]))
    indexer = prepare.fit_label_indexer(train, label, "_code")
    scaler = prepare.fit_scaler(train, names)
    coded = prepare.encode_labels(table, label, "_code", indexer).drop(label).withColumnRenamed("_code", label)
    return Prepared(prepare.scale(coded, scaler), names, indexer, scaler, ["clean", "impute", "encode", "scale"])


def engineer_features(df: DataFrame, order: Sequence[str], label: str | None = LABEL_COLUMN,
                      columns: Sequence[str] | None = None, extract: bool = True, transform: bool = True, choose: bool = True,
                      n: int = KEEP_FEATURES, max_correlation: float = MAX_CORRELATION,
                      min_variance: float = MIN_VARIANCE) -> tuple[DataFrame, list[str]]:
    """Rolling, ratio and difference features, row statistics and interactions, then selection.

    ``order`` is the row order the rolling features need and the key of the result. Returns the table with key, label and
    selected features, and the names of these.
    """
    keys = [*order, *([label] if label and label in df.columns else [])]
    base = list(columns or numeric_columns(df, exclude=keys))
    made = lambda frame: [c for c in frame.columns if c not in keys]
    out = df.select(*[col(c) for c in keys], *[col(c) for c in base])
    if extract:
        out = features.rolling_features(out, order, base)
        out = features.ratio_features(out, numeric=made(out))
        out = features.difference_features(out, made(out))
    if transform:
        out = pin(features.row_statistics(out, made(out)))  # read again for the variances and for the result
        out = features.interaction_features(out, columns=made(out))
        out = features.direction_ratios(out)
    if choose and not transform:
        out = pin(out)  # several passes follow: missing counts, correlations, variances
    names = made(out)
    flaws = out.agg(*[F.max(is_missing(out, c).cast("int")).alias(c) for c in names]).first() if choose else {}
    names = [c for c in names if not choose or not flaws[c]]
    if choose:
        names = select.select_features(out, label if label in df.columns else None, names, n, max_correlation, min_variance)
    return out.select(*[col(c) for c in keys], *[col(c) for c in names]), names


def engineer_splits(df: DataFrame, order: Sequence[str], label: str = LABEL_COLUMN,
                    selected: Sequence[str] | None = None) -> DataFrame:
    """Features chosen on the training split, projected on all splits; only columns the table itself has can be kept."""
    if selected is None:
        base = numeric_columns(df, exclude=[*order, label, "split"])
        train = df.filter(col("split") == "train").drop("split")
        selected = engineer_features(train, order, label, base)[1]
    kept = [c for c in selected if c in df.columns]
    return df.select(*order, *[col(c) for c in kept], label, "split")


def model_reports(df: DataFrame, label: str, detector: forest.Forest | None = None, classifier: Classifier | None = None,
                  benign: str = BENIGN) -> DataFrame:
    """One nested report row per given model: the detector against benign or not, the classifier on the class codes.

    Codes number the union of true and predicted labels in alphabetical order.
    """
    reports = []
    if detector is not None:
        judged = detector.decide(df).select(clean.binary_label(col(label), benign).cast("string").alias("y_true"),
                                            (col("prediction") == -1).cast("int").cast("string").alias("y_pred"))
        reports.append(metrics.evaluation_report(judged, "anomaly_detection_evaluation", metadata={"model": "isolation_forest"},
                                                 kind="experiment_name"))
    if classifier is not None:
        judged = pin(classifier.predict(df).select(F.trim(col(label)).alias("t"), col("predicted_label").alias("p")))
        labels = judged.select(F.explode(F.array("t", "p")).alias("label"))
        codes = prepare.label_codes(labels, "label").agg(F.map_from_entries(F.collect_list(F.struct("label", "code"))).alias("m")).scalar()
        coded = judged.withColumn("_m", codes).select(F.element_at("_m", col("t")).cast("string").alias("y_true"),
                                                      F.element_at("_m", col("p")).cast("string").alias("y_pred"))
        reports.append(metrics.evaluation_report(coded, "classification_evaluation", metadata={"model": "random_forest"},
                                                 kind="experiment_name"))
    if not reports:
        raise DataError("no model given")
    return reduce(DataFrame.unionByName, reports)


def score_by_deviation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute z-score of the given columns, as a model-free anomaly score."""
    scaled = prepare.scale(df, prepare.fit_scaler(df, columns))
    total = sum((F.abs(col(c)) for c in columns), F.lit(0.0))
    return scaled.withColumn("raw_score", -total / len(list(columns)))

