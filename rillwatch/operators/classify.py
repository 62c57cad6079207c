"""Multi-class classification with MLlib's random forest, and what is read off a fitted model."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BENIGN, CLASSIFIER_DEPTH, CLASSIFIER_LEAF, CLASSIFIER_TREES, SEED
from ..core import chain, col, pin, present, require
from ..errors import ModelError
from ..ordering import add_position
from ..quantiles import hash_order
from . import metrics
from .select import ranked


def _vector(df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Feature vector; missing numbers count as 0."""
    solid = {f"_x{i}": F.coalesce(present(df, c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)}
    made = VectorAssembler(inputCols=list(solid), outputCol=name).transform(df.withColumns(solid))
    return made.drop(*solid)


@dataclass(frozen=True)
class Classifier:
    model: RandomForestClassificationModel
    features: list[str]
    classes: list[str]
    stats: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds predicted_label, predicted_code, confidence, probabilities (map) and is_anomalous."""
        require(df, self.features)
        scored = self.model.transform(_vector(df, self.features, "_features"))
        names = F.array(*[F.lit(c) for c in self.classes])
        p = vector_to_array("_probability")
        return scored.select(*[col(c) for c in df.columns], p.alias("_p"), col("_code").cast("int").alias("predicted_code")) \
            .select(*[col(c) for c in df.columns], F.element_at(names, col("predicted_code") + 1).alias("predicted_label"),
                    "predicted_code", F.array_max("_p").alias("confidence"), F.map_from_arrays(names, "_p").alias("probabilities")) \
            .withColumn("is_anomalous", F.trim("predicted_label") != BENIGN)

    def score(self, df: DataFrame, label: str) -> DataFrame:
        return metrics.accuracy(self.predict(df), label, "predicted_label")

    def importance(self) -> DataFrame:
        """(feature, importance, rank): Gini importance."""
        spark = SparkSession.getActiveSession()
        values = self.model.featureImportances.toArray()
        return ranked(spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, values)],
                                            "feature string, importance double"))

    def importance_by_class(self) -> DataFrame:
        """The same ranking under each class name: a forest has no importance per class."""
        return self.importance().withColumn("class", F.explode(F.array(*[F.lit(c) for c in self.classes])))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"features": self.features, "classes": self.classes, "stats": self.stats}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> Classifier:
        meta = json.loads(SparkSession.getActiveSession().read.text(f"{path}/meta").first()[0])
        return Classifier(RandomForestClassificationModel.load(f"{path}/model"), **meta)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight rows / (classes x n), one row per class."""
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("s")).scalar()
    return counts.withColumn("weight", sizes.getField("rows") / (sizes.getField("classes") * col("n")))


def train(df: DataFrame, features: Sequence[str], label: str, trees: int = CLASSIFIER_TREES, depth: int = CLASSIFIER_DEPTH,
          min_leaf: int = CLASSIFIER_LEAF, weights: Mapping[str, float] | str | None = "balanced", seed: int = SEED) -> Classifier:
    """Random forest with sqrt features and Gini; ``weights`` is balanced, a weight per class (others 1), or none.

    Labels are trimmed.
    """
    require(df, [*features, label])
    df = df.withColumn(label, F.trim(col(label).cast("string")))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error").fit(df)
    classes = list(indexer.labels)
    if not classes:
        raise ModelError("cannot train on an empty table")
    if weights == "balanced":
        weights = {r["label"]: r["weight"] for r in class_weights(df, label).collect()}  # one row per class
    weight = chain([(col(label) == c, F.lit(float(w))) for c, w in (weights or {BENIGN: 1.0}).items()], F.lit(1.0))
    data = indexer.transform(_vector(df, features, "_features").withColumn("_weight", weight)).select("_features", "_label", "_weight")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", numTrees=trees,
                                    maxDepth=min(depth, 30), minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt",
                                    impurity="gini", seed=seed, predictionCol="_code", probabilityCol="_probability",
                                    rawPredictionCol="_raw", maxMemoryInMB=512)
    model = forest.fit(data)
    return Classifier(model, list(features), classes, {"n_features": len(features), "n_classes": len(classes), "n_trees": trees,
                                                       "max_depth": depth})


def train_with_validation(train_df: DataFrame, features: Sequence[str], label: str, validation: DataFrame | None = None,
                          **options) -> tuple[Classifier, DataFrame | None]:
    """The model, and the class report on the validation rows when there are any."""
    model = train(train_df, features, label, **options)
    return model, (validate(model, validation, label) if validation is not None else None)


def validate(model: Classifier, df: DataFrame, label: str) -> DataFrame:
    return metrics.class_report(metrics.pair_counts(model.predict(df), label, "predicted_label"))


def permuted(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int, placed: DataFrame | None = None) -> DataFrame:
    """The rows with ``_p_{column}``: the values of a row drawn without replacement in the order of a digest.

    The row at place i in key order is paired with the row at place i in digest order: a permutation found by two range sorts
    and one join on the place, never by collecting the table. ``placed`` is ``df`` with its places ``_at`` in key order, for
    callers that permute more than once.
    """
    own = add_position(df, [*key], "_at") if placed is None else placed
    other = df.select(*[col(c).alias(f"_p_{c}") for c in columns], hash_order(key, seed).alias("_lot"))
    return own.join(add_position(other, ["_lot"], "_at", ["_lot"]), "_at").drop("_at")


def permutation_importance(df: DataFrame, model: Classifier, label: str, key: Sequence[str], repeats: int = 10,
                           scoring: str = "accuracy", seed: int = SEED) -> DataFrame:
    """(feature, importance_mean, importance_std, rank): loss of the score when one feature is permuted.

    All features share one permutation per repeat: each row is scored once per feature, with that feature swapped. Where the
    features take few values, equal rows are scored once, with their number.
    """
    if scoring not in ("accuracy", "f1", "precision", "recall"):
        scoring = "accuracy"
    names = model.features
    base = metrics.class_report(metrics.pair_counts(model.predict(df), label, "predicted_label"))
    measure = {"accuracy": "accuracy", "f1": "weighted_f1_score", "precision": "weighted_precision", "recall": "weighted_recall"}[scoring]
    before = metrics.overall(base).first()[measure]
    parts = []
    rows = df.select(*[col(k) for k in key], *[col(c) for c in names], col(label).alias("_true"))
    # laid out by place once, as the join of each repeat wants it
    placed = pin(add_position(rows, [*key], "_at").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_at"))
    kinds = rows.agg(F.approx_count_distinct(F.struct(*[col(c) for c in names], "_true")).alias("kinds"), F.count(F.lit(1)).alias("n")).first()
    few = kinds["kinds"] ** 2 < kinds["n"]
    number = F.sum("_n") if few else F.count(F.lit(1))
    for repeat in range(repeats):
        swapped = permuted(rows, names, key, seed + repeat, placed)
        if few:
            swapped = swapped.groupBy("_true", *[col(c) for c in names], *[col(f"_p_{c}") for c in names]).agg(F.count(F.lit(1)).alias("_n"))
        rest = [c for c in ("_true", "_n") if c in swapped.columns]
        versions = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[
            col(f"_p_{x}" if x == c else x).alias(x) for x in names]) for c in names]))
        scored = model.predict(swapped.select(*rest, versions.alias("v")).select(*rest, "v.*"))
        parts.append(pin(scored.groupBy("feature", col("_true").alias("true"), col("predicted_label").alias("pred"))
                         .agg(number.alias("n")).withColumn("repeat", F.lit(repeat))))
    counts = reduce(DataFrame.unionAll, parts)
    losses = counts.groupBy("feature", "repeat").agg(_loss(counts, scoring, before)) if scoring == "accuracy" else \
        _weighted_losses(counts, measure, before)
    return ranked(losses.groupBy("feature").agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std")),
                  "importance_mean")


def _loss(counts: DataFrame, scoring: str, before: float) -> Column:
    return (F.lit(before) - F.sum(F.when(col("true") == col("pred"), col("n")).otherwise(0)) / F.sum("n")).alias("loss")


def _weighted_losses(counts: DataFrame, measure: str, before: float) -> DataFrame:
    """Weighted scores per (feature, repeat) from the pair counts, all class-sized."""
    keys = ["feature", "repeat"]
    hits = F.when(col("true") == col("pred"), col("n")).otherwise(0)
    by_true = counts.groupBy(*keys, col("true").alias("class")).agg(F.sum("n").alias("support"), F.sum(hits).alias("tp"))
    by_pred = counts.groupBy(*keys, col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    both = by_true.join(by_pred, [*keys, "class"], "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    value = {"weighted_precision": p, "weighted_recall": r, "weighted_f1_score": f1}[measure]
    return both.groupBy(*keys).agg((F.lit(before) - F.sum(value * col("support")) / F.sum("support")).alias("loss"))
