"""Models: invariants, since random draws cannot match another library's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.core import col, pin
from rillwatch.errors import ModelError
from rillwatch.operators import bagging, classify, detect, forest


@pytest.fixture(scope="module")
def flows(spark):
    """A dense cloud, twenty far rows, and a label that depends on x."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1000, 3))
    x[:20] += 12
    rows = [(i, float(a), float(b), float(c), "DoS Hulk" if a > 0 else "BENIGN") for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, Label string")


@pytest.fixture(scope="module")
def grown(flows):
    return forest.fit(flows, ["x", "y", "z"], ["id"], trees=60, contamination=0.02)


def test_forest_finds_the_far_rows(flows, grown):
    found = grown.decide(flows)
    hits = [r.id for r in found.filter("prediction = -1").collect()]
    assert sorted(hits) == list(range(20))
    low, high = found.agg(F.min("raw_score"), F.max("raw_score")).first()
    assert -1 <= low < high <= 0


def test_forest_does_not_depend_on_the_partitioning(flows, grown):
    again = forest.fit(flows.repartition(9), ["x", "y", "z"], ["id"], trees=60, contamination=0.02)
    assert again.nodes.equals(grown.nodes) and again.offset == grown.offset


def test_tree_shape(grown):
    sizes = grown.nodes.groupby("tree").size()
    assert len(sizes) == 60 and (sizes <= 2 * grown.sample_size - 1).all()
    assert (grown.nodes.loc[grown.nodes.feature >= 0, "right"] == grown.nodes.loc[grown.nodes.feature >= 0, "left"] + 1).all()


def test_scores_equal_a_walk_through_the_nodes(flows, grown):
    rows = grown.score(flows.limit(50)).collect()
    nodes = {(n.tree, n.node): n for n in grown.nodes.itertuples()}
    for r in rows[:10]:
        total = 0.0
        for t in range(60):
            n = nodes[(t, 0)]
            while n.feature >= 0:
                n = nodes[(t, n.left if r["xyz"[n.feature]] <= n.split else n.right)]
            total += n.path
        assert r.raw_score == pytest.approx(-(2 ** (-(total / 60) / float(forest.mean_path(grown.sample_size)))))


def test_sampling_on_a_large_table_keeps_the_sample_size(spark):
    df = spark.range(300_000).select("id", (col("id") % 1000 / 7.0).alias("x"))
    drawn = forest.sample_trees(df, ["x"], ["id"], 300_000, 50, 256, 42).groupBy("tree").count().collect()
    assert len(drawn) == 50 and all(700 < r["count"] < 1400 for r in drawn)


def test_options_and_errors(flows, spark):
    some = forest.fit(flows, ["x", "y", "z"], ["id"], trees=5, max_samples=0.1, max_features=0.4, bootstrap=True)
    assert some.sample_size == 100
    assert some.nodes.groupby("tree").feature.apply(lambda f: f[f >= 0].nunique()).max() == 1
    with pytest.raises(ModelError):
        forest.fit(flows.limit(0), ["x"], ["id"])


def test_threshold_is_the_percentile(flows):
    detector = forest.train_detector(flows, ["x", "y", "z"], ["id"], trees=30)
    found = forest.detect_anomalies(flows, detector)
    assert found.filter("is_anomaly").count() == 50
    assert found.filter("not is_anomaly and severity <> 'low'").count() == 0
    assert found.filter("confidence < 0 or confidence > 1").count() == 0


def test_save_and_load(flows, grown, tmp_path, spark):
    grown.save(spark, str(tmp_path / "f"))
    again = forest.Forest.load(spark, str(tmp_path / "f"))
    assert again.offset == grown.offset and again.features == grown.features
    assert again.score(flows).exceptAll(grown.score(flows)).count() == 0


@pytest.fixture(scope="module")
def classifier(flows):
    return classify.train(flows, ["x", "y", "z"], "Label", trees=15, depth=5)


def test_classifier(flows, classifier):
    assert classifier.classes == ["BENIGN", "DoS Hulk"]
    assert classifier.score(flows, "Label").first().accuracy > 0.98
    top = classifier.importance().orderBy("rank").first()
    assert top.feature == "x"


def test_permutation_importance(flows, classifier):
    for scoring in ("accuracy", "f1"):
        rows = classify.permutation_importance(flows, classifier, "Label", ["id"], 2, scoring).orderBy("rank").collect()
        assert rows[0].feature == "x" and rows[0].importance_mean > 0.3 and abs(rows[-1].importance_mean) < 0.05


def test_permutation_keeps_the_values(flows):
    p = classify.permuted(flows, ["x"], ["id"], 3)
    assert p.count() == 1000
    assert p.select("x").exceptAll(p.select(col("_p_x").alias("x"))).count() == 0
    assert p.filter("x <> _p_x").count() > 950


def test_two_stages(flows, grown, classifier):
    broken = flows.withColumn("y", F.when(col("id") != 500, col("y")))
    out = detect.detect(broken, grown, classifier, F.concat(F.lit("s"), col("id")))
    assert out.count() == 1000
    error = out.filter("predicted_class = 'ERROR'").collect()
    assert [r.id for r in error] == [500] and error[0].metadata["error"] and error[0].anomaly_score == 0.0
    assert out.filter("is_anomaly").count() == 20
    assert out.filter("is_anomaly and predicted_class = 'BENIGN'").count() == 0
    assert out.filter("not is_anomaly and is_zero_day").count() == 0
    alone = detect.detect(flows, None, classifier, col("id"))
    assert alone.filter("is_anomaly").count() == 0


def test_detection_in_one_pass(flows, grown, spark):
    """A forest from histograms classifies in the pass that scores: nothing is held, and the answers are those of the held way."""
    trained = bagging.train(flows, ["x", "y", "z"], "Label", ["id"], trees=15, depth=5)
    broken = flows.withColumn("y", F.when(col("id") != 500, col("y")))

    def never(df):
        raise AssertionError("held")

    out = detect.detect(broken, grown, trained, F.concat(F.lit("s"), col("id")), hold=never)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("ArrowEvalPython") == 2
    held = detect._named(pin(grown.decide(broken.withColumn("is_anomaly", F.lit(True)))), trained).select("id", "predicted_label", "confidence")
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 1000 and rows[500].predicted_class == "ERROR" and rows[500].metadata["error"]
    assert [i for i, r in rows.items() if r.is_anomaly] and all(r.detection_latency_ms >= 0 for r in rows.values())
    for r in held.collect():
        got = rows[r.id]
        if got.is_anomaly:
            assert got.classification_confidence == pytest.approx(r.confidence)
            assert got.predicted_class == (r.predicted_label if r.predicted_label != "BENIGN" and r.confidence >= 0.5 else "ZERO_DAY")
            assert sum(got.class_probabilities.values()) == pytest.approx(1)
        else:
            assert got.class_probabilities == {} and got.predicted_class in ("BENIGN", "ERROR")


def test_weights(flows):
    w = {r.label: r.weight for r in classify.class_weights(flows, "Label").collect()}
    n = {r["Label"]: r["count"] for r in flows.groupBy("Label").count().collect()}
    assert all(w[k] == pytest.approx(1000 / (2 * n[k])) for k in n)
