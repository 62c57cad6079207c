"""Jobs over many columns: their passes must not build code that grows with columns x ranks, and must give the plain results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.operators import profile, select
from rillwatch.ordering import add_rolling
from rillwatch.plans import pipelines
from rillwatch.quantiles import exact_quantiles

NAMES = [f"c{k}" for k in range(40)]
ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (400, 40)), 2)
    rows = [[float(v) for v in r] for r in x]
    for i, v in enumerate(ODD):
        rows[i][0] = v
    rows = [(i, "ab"[i % 2] if i % 7 else None, *r[:39], None) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"{c} double" for c in NAMES)).repartition(5)


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_quantiles_of_many_columns(wide):
    probs = [i / 16 for i in range(1, 16)]
    found = {(r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(wide, NAMES, probs).collect()}
    for c in NAMES:
        v = np.array([r[0] for r in wide.select(c).collect() if r[0] is not None and r[0] == r[0]])
        if not len(v):
            assert (c, probs[0]) not in found
            continue
        for p in probs:
            assert found[c, p] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_mutual_information_is_counted_in_batches(wide):
    edges = {c: [-0.5, 0.0, float("nan"), 0.5] for c in NAMES}
    counts = select._counted(wide, "label", edges)
    assert "inline" not in plan_of(counts)
    got = {(r["column"], r["bin"], r["label"]): r["n"] for r in counts.groupBy("column", "bin", "label").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for r in wide.collect():
        for c in NAMES:
            v = r[c]
            b = sum(v > e for e in (-0.5, 0.0, 0.5)) if v is not None and v == v else 0
            want[c, b, r["label"]] = want.get((c, b, r["label"]), 0) + 1
    assert got == want


def test_variances_leave_out_missing_values(wide, spark):
    rows = wide.filter("id > 5 or id < 2")
    found, plain = profile.variances(rows, NAMES), rows.agg(*[F.var_samp(F.when(~F.isnan(c), F.col(c))).alias(c) for c in NAMES]).first()
    assert found["c39"] is None
    assert [found[c] for c in NAMES[:39]] == pytest.approx([plain[c] for c in NAMES[:39]], rel=1e-12)
    one = spark.createDataFrame([(1e9, 5.0, None), (1e9, None, None), (1e9, float("nan"), None)], "a double, b double, c double")
    assert profile.variances(one) == {"a": 0.0, "b": None, "c": None}
    assert profile.variances(one.limit(0)) == {"a": None, "b": None, "c": None}


def test_rolling_rows_are_dealt_over_many_tasks(spark):
    rows = add_rolling(spark.range(250_000).withColumn("v", F.col("id") % 10), ["id"], 3, {"s": ("sum", "v")})
    assert rows.filter(f"s != {' + '.join(f'greatest(id - {k}, 0) % 10' for k in range(3))}").count() == 0
    homes = plan_of(rows)
    assert "100000" in homes and "1000000" not in homes


def test_engineered_features_by_hand(spark):
    rows = spark.createDataFrame([(i, "xyz"[i % 3], float((i * 37) % 101)) for i in range(300)], "id long, kind string, value double")
    made, names = pipelines.engineer_features(rows, ["id"], "kind", ["value"], n=6)
    assert len(names) == 6 and made.count() == 300 and made.columns == ["id", "kind", *names]
