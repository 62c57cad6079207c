"""Two-stage detection: the forest flags rows, the classifier names the flagged ones, what it cannot name is a zero-day."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BENIGN, MIN_CONFIDENCE, UNKNOWN, ZERO_DAY
from ..core import col, is_infinite, is_missing, pin
from ..functions.rules import severity_plain, sigmoid_score
from .bagging import BaggedForest
from .classify import Classifier
from .forest import Forest

_NO_PROBABILITIES = "map<string,double>"


def _broken(df: DataFrame, features: Sequence[str]) -> Column:
    bad = F.lit(False)
    for c in features:
        bad = bad | is_missing(df, c) | F.coalesce(is_infinite(col(c)), F.lit(False))
    return bad


def _named(scored: DataFrame, classifier: Classifier | None) -> DataFrame:
    """Class, confidence and class shares: flagged rows (of a frame that is held) go through the classifier, the rest is unioned back."""
    nothing = {"predicted_label": F.lit(BENIGN), "confidence": F.lit(1.0), "probabilities": F.create_map().cast(_NO_PROBABILITIES)}
    flagged = scored.filter("is_anomaly")
    named = flagged.withColumns(nothing) if classifier is None else classifier.predict(flagged).drop("predicted_code", "is_anomalous")
    return scored.filter("not is_anomaly").withColumns(nothing).unionByName(named)


def _named_in_passing(scored: DataFrame, classifier: Classifier | BaggedForest | None) -> DataFrame | None:
    """The same in the pass that scores, without holding a row; None if the classifier can't do so."""
    if classifier is None:
        return scored.withColumns({"predicted_label": F.lit(BENIGN), "confidence": F.lit(1.0), "probabilities": F.create_map().cast(_NO_PROBABILITIES)})
    shares = classifier.shares_column(scored, col("is_anomaly")) if isinstance(classifier, BaggedForest) else None
    if shares is None:
        return None
    names = F.array(*[F.lit(c) for c in classifier.classes])
    voted = scored.withColumn("_shares", shares)
    best = F.element_at(names, F.array_position("_shares", F.array_max("_shares")).cast("int"))
    none = F.create_map().cast(_NO_PROBABILITIES)
    normal = col("_shares").isNull()
    return voted.withColumns({"predicted_label": F.when(normal, BENIGN).otherwise(best), "confidence": F.when(normal, 1.0).otherwise(F.array_max("_shares")),
                              "probabilities": F.when(normal, none).otherwise(F.map_from_arrays(names, "_shares"))}).drop("_shares")


def detect(df: DataFrame, forest: Forest | None, classifier: Classifier | None, sample_id: Column,
           min_confidence: float = MIN_CONFIDENCE, hold: Callable[[DataFrame], DataFrame] = pin) -> DataFrame:
    """One detection per row; the key and other columns of the input stay.

    Rows pass through once: they are scored, and the flagged ones of each batch classified, without a shuffle or a copy.
    ``detection_latency_ms`` is then the time of scoring a row's batch divided by its rows (null for a forest that is kept in Spark).
    A classifier that only takes whole frames (MLlib's) needs the scored rows held (pinned; a stream passes its own way of
    holding): flagged ones go through it, the rest is unioned back, and the latency is that of the held pass, the same for all rows.
    A row without usable features stays as class ERROR.
    """
    rows = df.withColumn("sample_id", sample_id.cast("string"))
    if forest is None:
        scored = rows.withColumns({"_error": F.lit(False), "decision": F.lit(None).cast("double")})
    else:
        rows = rows.withColumn("_error", _broken(rows, forest.features))
        if forest.nodes is None:
            scored = forest.decide(rows).drop("raw_score", "prediction")
        else:
            scored = rows.withColumn("_timed", forest.timed_score_column(rows)).withColumns(
                {"decision": F.col("_timed.score") - F.lit(forest.offset), "_ms": F.col("_timed.ms")}).drop("_timed")
    scored = scored.withColumn("is_anomaly", F.coalesce(~col("_error") & (col("decision") < 0), F.lit(False)))
    named = _named_in_passing(scored, classifier)
    if named is None:
        began = time.perf_counter()
        scored = hold(scored)
        rows_scored = scored.count()  # where ``hold`` is lazy, this is the pass
        latency = F.lit((time.perf_counter() - began) * 1000 / max(1, rows_scored))
        named = _named(scored, classifier)
    else:
        latency = col("_ms") if "_ms" in named.columns else F.lit(None).cast("double")
    zero_day = col("is_anomaly") & ((col("predicted_label") == BENIGN) | (col("confidence") < min_confidence))
    score = F.when(col("_error") | col("decision").isNull(), F.lit(0.0)).otherwise(sigmoid_score(col("decision")))
    label = F.when(col("_error"), "ERROR").when(zero_day, ZERO_DAY).otherwise(col("predicted_label"))
    keep = [c for c in df.columns if c != "sample_id"]
    made = named.select(
        *[col(c) for c in keep], "sample_id", "is_anomaly", score.alias("anomaly_score"),
        F.lit(forest.threshold if forest else 0.5).alias("anomaly_threshold"), label.alias("predicted_class"),
        F.when(col("_error"), 0.0).otherwise(col("confidence")).alias("classification_confidence"),
        col("probabilities").alias("class_probabilities"), zero_day.alias("is_zero_day"),
        latency.alias("detection_latency_ms"),
        F.when(col("_error"), F.create_map(F.lit("error"), F.lit("missing or infinite feature")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    severity = severity_plain(col("anomaly_score"), col("classification_confidence"), col("is_zero_day"))
    return made.withColumn("severity", severity)


def classify_flagged(df: DataFrame, flag: str, classifier: Classifier) -> DataFrame:
    """Stage two alone: flagged rows are classified, all others are benign. Adds final_label."""
    other = df.filter(~F.coalesce(col(flag), F.lit(False))).withColumn("final_label", F.lit(BENIGN))
    named = classifier.predict(df.filter(col(flag)))
    return other.unionByName(named.select(*[col(c) for c in df.columns], F.coalesce("predicted_label", F.lit(UNKNOWN)).alias("final_label")))
