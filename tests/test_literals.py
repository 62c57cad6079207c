"""Operators on literal frames with known results."""

import math

import pytest
from pyspark.sql import functions as F

from rillwatch.constants import FLOW_FEATURES
from rillwatch.core import col
from rillwatch.errors import DataError, ModelError
from rillwatch.functions import rules
from rillwatch.operators import clean, curves, features, metrics, opstats, prepare, profile, select, validate
from rillwatch.plans import pipelines
from rillwatch.sources import alert_store, scans

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1.0, 10.0, 100.0), (None, 20.0, 200.0), (3.0, None, 300.0), (NAN, 40.0, 400.0), (5.0, 50.0, None)],
                                 "col_a double, col_b double, col_c double")


@pytest.fixture(scope="module")
def alerts(spark):
    rows = [("alert-001", "critical", "ZERO_DAY", 0.95, 0.3, True), ("alert-002", "high", "DoS Hulk", 0.85, 0.92, False),
            ("alert-003", "medium", "DoS GoldenEye", 0.6, 0.78, False), ("alert-004", "low", "BENIGN", 0.3, 0.6, False),
            ("alert-005", "high", "ZERO_DAY", 0.88, 0.4, True)]
    df = spark.createDataFrame(rows, "alert_id string, severity string, predicted_class string, anomaly_score double, "
                                     "classification_confidence double, is_zero_day boolean")
    return df.withColumns({"timestamp": F.lit("2024-01-02 03:04:05.000006").cast("timestamp_ntz"), "sample_id": F.lit("s"),
                           "message": F.lit('said "no", twice')})


def values(df, column):
    return [r[column] for r in df.select(col(column)).collect()]


def test_missing_strategies(gaps):
    assert clean.handle_missing(gaps, "drop").count() == 1
    filled = clean.handle_missing(gaps, "fill", fill_value=0.0)
    assert filled.count() == 5 and clean.missing_summary(filled).count() == 0
    assert clean.handle_missing(gaps, "drop_columns").columns == ["col_a", "col_b", "col_c"]
    assert clean.handle_missing(gaps, "drop_columns", threshold=0.3).columns == ["col_b", "col_c"]
    with pytest.raises(DataError):
        clean.handle_missing(gaps, "guess")


def test_missing_counts_nan_and_null(gaps):
    assert {r["column"]: r["missing"] for r in clean.missing_summary(gaps).collect()} == {"col_a": 2, "col_b": 1, "col_c": 1}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (1, 10), (3, 30), (2, 20)], "col_a long, col_b long")
    assert clean.drop_duplicates(df).count() == 3
    assert clean.duplicate_count(df).first().duplicates == 2


def test_infinite(spark):
    df = spark.createDataFrame([(1.0,), (INF,), (3.0,), (-INF,), (None,)], "a double")
    assert sorted(values(clean.replace_infinite(df, -1.0).na.drop(), "a")) == [-1.0, -1.0, 1.0, 3.0]
    assert clean.infinite_counts(df).first().infinite == 2


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in [*range(100), 10000]], "a double")
    bounds = clean.clip_bounds(df, 99.0)
    assert bounds.count() == 1
    assert max(values(clean.clip_outliers(df, 99.0), "a")) == pytest.approx(bounds.first().upper) and bounds.first().upper < 10000
    calm = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    assert clean.clip_bounds(calm, 100.0).count() == 0
    assert sorted(values(clean.clip_outliers(calm, 100.0), "a")) == [1.0, 2.0, 3.0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert clean.clean(empty).count() == 0
    assert clean.cleaning_report(empty).first().rows_dropped == 0
    with pytest.raises(DataError):
        prepare.impute(empty)
    assert validate.check_structure(empty).first().check == "empty"


def test_impute(gaps):
    assert sorted(values(prepare.impute(gaps, "mean"), "col_a")) == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert sorted(values(prepare.impute(gaps, "most_frequent"), "col_a"))[0] == 1.0
    assert prepare.impute(gaps, "drop").count() == 1
    with pytest.raises(DataError):
        prepare.fit_imputer(gaps, strategy="drop")


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling(spark, method):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (INF, 7.0)], "a double, same double")
    fitted = prepare.fit_scaler(df, method=method)
    scaled = prepare.scale(df, fitted)
    assert set(values(scaled, "same")) == {0.0}
    a = values(scaled, "a")
    if method == "standard":
        assert sum(a) == pytest.approx(0) and sum(x * x for x in a) / 4 == pytest.approx(1)
    if method == "minmax":
        assert min(a) == 0.0 and max(a) == 1.0
    assert sorted(values(prepare.unscale(scaled, fitted), "a")) == pytest.approx([0.0, 1.0, 2.0, 3.0])
    with pytest.raises(DataError):
        prepare.fit_scaler(df, method="other")


def test_labels(spark):
    df = spark.createDataFrame([("b ",), ("a",), ("b",)], "Label string")
    trimmed = scans.trim_labels(df, " Label")
    assert {r.label: r.code for r in prepare.label_codes(trimmed, "Label").collect()} == {"a": 0, "b": 1}
    model = prepare.fit_label_indexer(trimmed, "Label", "code")
    with pytest.raises(Exception):
        prepare.encode_labels(spark.createDataFrame([("new",)], "Label string"), "Label", "code", model).collect()
    with pytest.raises(DataError):
        scans.trim_labels(df, "Other")


def test_split_is_exact_and_stratified(spark):
    df = spark.range(1000).select("id", F.when(col("id") % 10 < 8, "BENIGN").otherwise("DoS Hulk").alias("Label"))
    out = prepare.add_split(df, ["id"], "Label")
    got = {(r["Label"], r["split"]): r["count"] for r in out.groupBy("Label", "split").count().collect()}
    assert got == {("BENIGN", "train"): 560, ("BENIGN", "val"): 80, ("BENIGN", "test"): 160,
                   ("DoS Hulk", "train"): 140, ("DoS Hulk", "val"): 20, ("DoS Hulk", "test"): 40}
    again = prepare.add_split(df.repartition(7), ["id"], "Label")
    assert out.exceptAll(again).count() == 0
    with pytest.raises(DataError):
        prepare.add_split(df, ["id"], "Label", 0.6, 0.4)


def test_severity_with_boost(spark):
    cases = [(0.2, False, "low"), (0.8, True, "critical"), (0.9, True, "critical"), (0.6, True, "high"), (0.4, True, "medium"),
             (0.7, True, "critical"), (0.1, True, "low"), (0.5, True, "high"), (0.88, True, "critical")]
    df = spark.createDataFrame(cases, "score double, zero_day boolean, want string")
    assert df.filter(rules.severity_boosted(col("score"), col("zero_day")) != col("want")).count() == 0


def test_alert_summary_and_sinks(spark, alerts, tmp_path):
    got = {(r.breakdown, r.key): (r.n, r.zero_days) for r in opstats.breakdown(alerts).collect()}
    assert got[("total", "")] == (5, 2) and got[("severity", "high")] == (2, 1) and got[("class", "ZERO_DAY")] == (2, 2)
    for fmt in ("json", "csv"):
        alert_store.write_alerts(alerts, str(tmp_path / fmt), fmt)
        back = alert_store.read_alerts(spark, str(tmp_path / fmt / fmt), fmt)
        assert back.drop("alert_date").exceptAll(alerts.select(*back.drop("alert_date").columns)).count() == 0
        assert alert_store.read_alerts(spark, str(tmp_path / fmt / fmt), fmt, limit=2).count() == 2
    untimed = alert_store.stamped(alerts.drop("timestamp"))
    assert untimed.filter("timestamp is null").count() == 0


def test_metrics_extremes(spark):
    right = spark.createDataFrame([("A", "A"), ("B", "B")], "y_true string, y_pred string")
    wrong = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "A"), ("B", "A")], "y_true string, y_pred string")
    summary = lambda d: metrics.overall(metrics.class_report(metrics.pair_counts(d))).first()
    assert summary(right).accuracy == 1.0 and summary(right).weighted_f1_score == 1.0
    assert summary(wrong).accuracy == 0.0 and summary(wrong).macro_f1_score == 0.0
    one = spark.createDataFrame([(1, 0.3), (1, 0.7)], "y int, score double")
    assert curves.roc_auc(one, "y", "score").first().auc == 0.5
    assert curves.roc_auc_by_row(one.withColumn("k", col("score")), "y", "score", ["k"]).first().auc == 0.5


def test_auc_ties_and_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, score double")
    assert curves.roc_auc(df, "y", "score").first().auc == pytest.approx(0.875)
    best = curves.best_threshold(df, "y", "score", "f1").first()
    assert (best.threshold, best.score) == (0.5, pytest.approx(0.8))
    none = spark.createDataFrame([(0, 0.4)], "y int, score double")
    assert tuple(curves.best_threshold(none, "y", "score").first()) == (0.5, 0.0)
    with pytest.raises(DataError):
        curves.search_threshold(df, "y", "score", "accuracy")


def test_calibration_leaves_out_certainty(spark):
    df = spark.createDataFrame([("A", "A", 1.0), ("A", "A", 0.95), ("A", "B", 0.05)], "t string, p string, c double")
    rows = metrics.calibration(df, "t", "p", "c").collect()
    assert sum(r.n for r in rows) == 2 and rows[0].ece == pytest.approx(0.05)


def test_feature_arithmetic(spark):
    df = spark.createDataFrame([(4.0, 0.0, -2.0), (9.0, 3.0, None)], "a double, b double, c double")
    r = features.ratio_features(df, ["a"], ["b", "c"]).orderBy("a").collect()
    assert [x["a__ratio__b"] for x in r] == [0.0, 3.0] and [x["a__ratio__c"] for x in r] == [-2.0, 0.0]
    s = features.row_statistics(df).orderBy("a").collect()
    assert s[0].row_median == 0.0 and s[1].row_mean == 6.0 and s[1].row_std == pytest.approx(math.sqrt(18))
    assert features.log_features(df, ["c"]).orderBy("a").first()["c"] == pytest.approx(0.0)
    assert df.columns == features.direction_ratios(df).columns


def test_flow_headers_with_slash(spark):
    df = spark.createDataFrame([(4.0, 2.0)], ["Fwd Packets/s", "Bwd Packets/s"])
    assert features.direction_ratios(df).first()["Fwd Packets/s__ratio__Bwd Packets/s"] == 2.0
    assert scans.select_configured(df, FLOW_FEATURES).columns == ["Fwd Packets/s", "Bwd Packets/s"]


def test_constant_column_has_no_correlation(spark):
    df = spark.range(50).select(col("id").cast("double").alias("x"), (col("id") * 2.0).alias("y"), F.lit(1.0).alias("one"))
    assert {r.feature: r.correlation for r in select.target_correlation(df, "y").collect()} == {"x": pytest.approx(1.0), "one": 0.0}
    pairs = {(r.a, r.b): r.r for r in profile.correlation_pairs(df, ["x", "y", "one"]).collect()}
    assert pairs[("x", "y")] == pytest.approx(1.0) and pairs[("x", "one")] is None
    assert select.redundant(df) == ["y"]


def test_pairwise_correlation_with_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, 6.0, 1.0), (4.0, NAN, 2.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in profile.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0)
    assert got[("a", "c")] == pytest.approx(df.na.drop(subset=["c"]).select(F.corr("a", "c")).first()[0])


def test_preparation_records_errors(gaps):
    out = pipelines.prepare_table(gaps.withColumn("Label", F.lit("BENIGN")).filter("col_a > 100"), encoding=False, scaling=False)
    assert out.steps == ["clean"] and out.errors[0].startswith("impute")
    kept = pipelines.prepare_table(gaps.withColumn("Label", F.lit("BENIGN")), missing="keep")
    assert kept.table.count() == 5 and kept.steps == ["clean", "impute", "encode", "scale"]


def test_flawless_fails_at_the_first_flaw(gaps):
    with pytest.raises(Exception, match="missing or infinite"):
        validate.flawless(gaps).collect()
    with pytest.raises(DataError):
        validate.require_columns(gaps, ["col_a", "absent"])


def test_sliding_windows_end_with_the_table(spark):
    df = spark.range(10)
    got = sorted({(r.window_start, r.window_end) for r in opstats.sliding_windows(df, ["id"], 4, 3).collect()})
    assert got == [(0, 4), (3, 7), (6, 10)]
    assert {(r.window_start, r.window_end) for r in opstats.sliding_windows(df, ["id"], 20).collect()} == {(0, 10)}


def test_missing_file_is_an_error(spark):
    with pytest.raises(DataError):
        scans.read_csv(spark, "/tmp/no-such-file.csv", "a double")


def test_threshold_range():
    import pandas as pd

    from rillwatch.operators.forest import Forest
    with pytest.raises(ModelError):
        Forest(pd.DataFrame(), [], 1).with_threshold(1.5)


def test_csv_line_quotes_fields_with_commas(spark):
    row = ("a1", "s1", "high", "DoS", 0.5, 0.25, False, 'one, "two"')
    df = spark.createDataFrame([row], "alert_id string, sample_id string, severity string, predicted_class string, anomaly_score double, "
                                      "classification_confidence double, is_zero_day boolean, message string")
    line = rules.formatted_alerts(df, "csv", F.lit(None)).first().line
    assert line == 'a1,s1,high,DoS,0.5,0.25,False,"one, ""two"""'


def test_totals_are_told_from_groups_without_a_name(spark):
    log = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0)], "operation string, duration_ms double")
    got = {(r.operation, r.overall): (r["count"], r.p50_ms) for r in opstats.latency_statistics(log).collect()}
    assert got == {("a", False): (2, 2.0), (None, False): (1, 10.0), (None, True): (3, 3.0)}


def test_first_alerts_of_a_folder(spark, tmp_path):
    rows = spark.range(50).select(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id")).alias("timestamp"), F.concat(F.lit("a"), F.col("id")).alias("alert_id"))
    alert_store.write_json(rows.repartition(4), str(tmp_path / "alerts"))
    assert [r.alert_id for r in alert_store.read_alerts(spark, str(tmp_path / "alerts"), limit=3).collect()] == ["a49", "a48", "a47"]


def test_shared_folder_must_be_named_off_a_local_master():
    from types import SimpleNamespace

    from rillwatch import core
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(DataError):
        core.shared_folder(SimpleNamespace(sparkContext=context))
