"""Pairwise moments and distinct wide rows against plain computation, over blocks, tasks and odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.operators import clean, gram, profile


@pytest.mark.parametrize("block", [3, 128])
def test_moments_over_the_rows_where_both_are_present(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    monkeypatch.setattr(gram, "_TASKS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 8))
    x[:, 1] = 1e9 + x[:, 0] * 0.5 + 0.1 * x[:, 1]  # a large offset
    x[:, 2] = 7.3
    x[rng.random(900) < 0.3, 3] = np.nan
    x[:, 4] = np.where(np.arange(900) == 5, 2.0, np.nan)
    x[:, 5] = np.nan
    x[:400, 6] = np.nan
    names = [f"c {i}" for i in range(8)]
    rows = [tuple(float(v) if i % 2 or not np.isnan(v) else None for i, v in enumerate(r)) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7)
    got = {(r.a, r.b): r for r in gram.pair_moments(df, names).collect()}
    r_of = {(r.a, r.b): r.r for r in profile.correlation_pairs(df, names).collect()}
    assert set(got) == set(r_of) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for i, a in enumerate(names):
        for j, b in enumerate(names[i + 1:], i + 1):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            p, q, m = x[both, i], x[both, j], got[a, b]
            assert m.n == both.sum()
            if both.any():
                assert (m.mean_a, m.mean_b) == pytest.approx((p.mean(), q.mean()), rel=1e-12)
                want = [((p - p.mean()) * (q - q.mean())).sum(), ((p - p.mean()) ** 2).sum(), ((q - q.mean()) ** 2).sum()]
                assert (m.c_ab, m.c_aa, m.c_bb) == pytest.approx(want, rel=1e-6, abs=1e-6)
            defined = both.any() and len(set(p)) > 1 and len(set(q)) > 1
            assert r_of[a, b] == (pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-7) if defined else None)
    none = profile.correlation_pairs(df.limit(0), names).collect()
    assert len(none) == 28 and all(r.r is None for r in none)


def test_five_hundred_columns_in_one_scan(spark):
    wide = spark.range(300, numPartitions=3).select(*[F.sin(F.col("id") * (i % 37 + 1) + i).alias(f"c{i}") for i in range(500)])
    pairs = profile.correlation_pairs(wide, wide.columns)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "RDD" not in plan
    assert pairs.count() == pairs.filter("r IS NOT NULL").count() == 500 * 499 // 2


def test_distinct_wide_rows(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id % 1900 AS id", "CASE WHEN id % 3 > 0 THEN 'text' END AS t", "IF(id % 1900 = 7, double('NaN'), id % 1900 / 4.0) AS x")
    rows = rows.withColumn("t", F.when(F.col("id") != 9, F.col("t")))
    want = rows.distinct()
    got = clean.drop_duplicates_wide(rows)
    assert got.columns == rows.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Join" in plan
    monkeypatch.setattr(clean, "BROADCAST_BYTES", 10)
    assert clean.drop_duplicates_wide(rows).exceptAll(want).count() == 0
    assert clean.drop_duplicates_wide(rows.limit(0)).count() == 0
