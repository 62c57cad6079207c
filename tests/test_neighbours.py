"""Neighbour-based mutual information against a direct version over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.errors import DataError
from rillwatch.operators import neighbours


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def direct(rows, k):
    """Of one column's (class, value) pairs: every distance, sorted."""
    sizes = {}
    for c, _ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    if not rows:
        return 0.0
    classes, x = np.array([c for c, _ in rows]), np.array([v for _, v in rows])
    total = 0.0
    for i, (c, v) in enumerate(rows):
        of = min(k, sizes[c] - 1)
        away = np.abs(x - v)
        own = np.sort(np.delete(away, i)[np.delete(classes, i) == c])
        inside = int((away < own[of - 1]).sum())
        total += psi(of) - psi(sizes[c]) - psi(max(inside, 1))
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize(("k", "chunk"), [(3, 1_000_000), (3, 40), (1, 7)])
def test_information_against_all_pairs(spark, k, chunk):
    rng = np.random.default_rng(2)
    n = 700
    label = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 5))
    x[:, 0] += 2 * label  # tells of the class
    x[:, 1] = label + 0.3 * rng.normal(0, 1, n)  # more
    x[:, 3] = np.round(x[:, 3])  # ties
    x[:, 4] = 5.0
    rows = [(i, *(None if i % 50 == j else float(v) for j, v in enumerate(r)), f"c{c}" if i % 41 else None) for i, (r, c) in enumerate(zip(x, label))]
    rows[3] = (*rows[3][:-1], "alone")
    rows[100:102] = [(*r[:-1], "two") for r in rows[100:102]]
    names = [f"x {j}" for j in range(5)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"`{c}` double" for c in names) + ", label string").repartition(4)
    got = {r["column"]: r["mi"] for r in neighbours.neighbour_information(df, "label", ["id"], names, k, chunk).collect()}
    held = neighbours.cells(df, "label", names, ["id"]).collect()
    for j, c in enumerate(names):
        assert got[c] == pytest.approx(direct([(r["class"], r["value"]) for r in held if r["column"] == j], k), abs=1e-9), c
    assert got["x 1"] > got["x 0"] > 0.3 > got["x 2"]


def test_digamma_and_odd_tables(spark):
    got = [r[0] for r in spark.range(1, 200).orderBy("id").select(neighbours.digamma(F.col("id"))).collect()]
    assert got == pytest.approx([psi(n) for n in range(1, 200)], abs=1e-12)
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id long, x double, label string")
    assert [r["mi"] for r in neighbours.neighbour_information(df, "label", ["id"]).collect()] == [0.0]
    assert [r["mi"] for r in neighbours.neighbour_information(df.limit(0), "label", ["id"]).collect()] == [0.0]
    with pytest.raises(DataError):
        neighbours.neighbour_information(df, "label", ["id"], k=0)
    assert math.isfinite(got[0])
