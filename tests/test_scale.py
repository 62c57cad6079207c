"""What must hold when the data grows: paths for large tables, skew, repartitioning, and the shape of plans."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillwatch import ordering, quantiles
from rillwatch.core import col
from rillwatch.operators import curves, features, limits, opstats, prepare
from rillwatch.plans import inputs
from rillwatch.sources import scans


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def skewed(spark):
    """One source holds most of the rows, and a third of all values are equal."""
    return spark.range(6000).select("id", F.when(col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("s"), (col("id") % 7).cast("string"))).alias("g"),
                                    F.when(col("id") % 3 == 0, 5.0).otherwise((col("id") * 7919 % 1000) / 10.0).alias("v")).repartition(6)


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_quantiles_equal_spark_with_null_groups(skewed, monkeypatch, by, accuracy):
    """The same path at every size: a coarse digest stands for a large table. Null keys are groups."""
    probs = [0.0, 0.005, 0.333, 0.5, 0.95, 1.0]
    rows = skewed.withColumns({"g": F.when(col("g") != "s3", col("g")), "h": F.when(col("id") % 5 > 0, col("id") % 2)})
    at = F.array(*[F.lit(p) for p in probs])
    want = {}
    for c in ("v", "id"):
        for r in rows.groupBy(*by).agg(F.percentile(c, at).alias("q")).collect():
            want |= {(*[r[b] for b in by], c, p): q for p, q in zip(probs, r.q)}
    monkeypatch.setattr(quantiles, "_ACCURACY", accuracy)
    got = {(*[r[b] for b in by], r.column, r.prob): r.quantile for r in quantiles.exact_quantiles(rows, ["v", "id"], probs, by).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    if by:
        floors = {(*[r[b] for b in by], r.prob) for r in quantiles.floor_index_quantiles(rows, "v", [0.5], by).collect()}
        assert floors == {(*k[:len(by)], 0.5) for k in want}


def test_cool_down_keeps_rows_without_a_source(spark):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.when(col("id") % 4 > 0, F.lit("a")).alias("s"))
    kept = limits.cool_down(rows, "s", "ts", "id", 60, slice_seconds=600).collect()
    assert sorted(r.id for r in kept if r.s is None) == list(range(0, 100, 4))


def test_forest_samples_are_binomial(spark):
    from rillwatch.operators import forest
    rows = spark.range(4000).select("id", F.rand(1).alias("x"))
    for trees, sample in ((20, 50), (200, 400), (5, 4000)):  # share of a row per tree: 0.05, 0.4, 1
        drawn = forest.sample_trees(rows, ["x"], ["id"], 4000, trees, sample, 3)
        sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
        share = min(1.0, 4 * sample / 4000)
        assert len(sizes) == trees and abs(sum(sizes) / (trees * 4000 * share) - 1) < 0.05
        assert drawn.select("tree", "_rank").distinct().count() == sum(sizes)


def test_split_places_rows_without_a_label(spark):
    rows = spark.range(400).select("id", F.when(col("id") % 2 == 0, F.concat(F.lit(" "), F.lit("b"))).alias("label"))
    sizes = {(r.label, r.split): r["count"] for r in prepare.add_split(rows, ["id"], "label").groupBy("label", "split").count().collect()}
    assert {k[1]: v for k, v in sizes.items() if k[0] is None} == {k[1]: v for k, v in sizes.items() if k[0]}


def test_position_and_totals_with_a_hot_value(skewed):
    rows = ordering.add_position(skewed, ["g", "v", "id"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(6000))
    assert [(r.g, r.v, r.id) for r in rows] == sorted((r.g, r.v, r.id) for r in rows)
    run = ordering.add_running_totals(skewed, ["v", "id"], {"total": "id"}).orderBy("v", "id").collect()
    seen = 0
    for r in run:
        seen += r.id
        assert r.total == seen
    inside = ordering.add_group_position(skewed, ["g"], ["v", "id"]).groupBy("g").agg(F.max("position").alias("m"), F.count(F.lit(1)).alias("n"))
    assert all(r.m == r.n - 1 for r in inside.collect())


def test_hot_value_is_cut_by_the_other_order_columns(skewed):
    placed = ordering._placed(skewed.repartition(4), ["g", "v", "id"])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert max(sizes) <= 6000


def test_rolling_over_chunk_borders(skewed):
    wanted = {"m": ("mean", "v"), "s": ("std", "v"), "lo": ("min", "v")}
    from pyspark.sql import Window
    for by in ([], ["g"]):
        got = ordering.add_rolling(skewed, ["id"], 5, wanted, by, chunk_rows=37)
        w = Window.partitionBy(*by).orderBy("id").rowsBetween(-4, 0)
        want = skewed.select("*", F.avg("v").over(w).alias("m"), F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)).alias("s"), F.min("v").over(w).alias("lo"))
        both = got.join(want.select("id", *[col(c).alias(f"w_{c}") for c in wanted]), "id")
        assert both.count() == 6000
        assert both.filter(" or ".join(f"abs({c} - w_{c}) > 1e-9" for c in wanted)).count() == 0


def test_hash_cuts_are_exact_ranks(skewed):
    digest = quantiles.hash_order(["id"], 1)
    cuts = quantiles.hash_cuts(skewed, col("g"), digest, {"k": F.lit(100)}).filter("`group` = 'hot'").first().digest
    ordered = sorted(r[0] for r in skewed.filter("g = 'hot'").select(digest).collect())
    assert ordered[99] == cuts


def brute_cool_down(rows, wait):
    kept, last = [], {}
    for source, t, ident in sorted(rows, key=lambda r: (r[1], r[2])):
        if source not in last or t - last[source] >= wait:
            last[source] = t
            kept.append(ident)
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cool_down_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), rng.randrange(0, 4000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, t long, id long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    for wait, width in ((10, 10), (10, 45), (7, 600), (60, 120)):
        got = sorted(r.id for r in limits.cool_down(df, "source", "ts", "id", wait, width).collect())
        assert got == brute_cool_down(rows, wait), (wait, width)


def test_anchored_minutes_equal_brute_force(spark):
    rng = random.Random(9)
    rows = sorted((rng.randrange(0, 5000), i) for i in range(2000))
    want, start, n = [], None, 0
    for t, i in rows:
        if start is None or t - start > 60:
            start, n = t, 0
        n += 1
        if n <= 5:
            want.append(i)
    df = spark.createDataFrame(rows, "t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.id for r in limits.anchored_minute_limit(df, "ts", "id", 5).collect()) == sorted(want)


def brute_actions(rows, limit, span):
    done, out = [], []
    for t, ident in sorted(rows):
        done = [d for d in done if d > t - span]
        if len(done) < limit:
            done.append(t)
            out.append(ident)
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
def test_action_limit_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([rng.randrange(0, 300), rng.randrange(1000, 1100), rng.randrange(5000, 9000)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    for limit in (1, 3, 40):
        got = sorted(r.id for r in limits.action_limit(df, "ts", "id", limit, 60).filter("executed").collect())
        assert got == brute_actions(rows, limit, 60)


def test_minute_limit_is_thinned_before_the_shuffle(spark, sf):
    d = inputs.detections(spark, sf)
    text = plan(limits.per_minute_limit(d, "ts", "event_id", 60))
    assert text.count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = scans.keep_known_labels(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "N", ["A"]).select("l_quantity", "l_returnflag")
    text = plan(df)
    assert "PushedFilters: [In(l_returnflag" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def test_fitted_statistics_are_no_join(spark, sf):
    flows = inputs.flows(spark, sf)
    text = plan(prepare.scale(flows, prepare.fit_scaler(flows, inputs.NUMERIC)))
    assert "Join" not in text and "CartesianProduct" not in text and "Subquery" in text


def test_split_pruning(spark, sf, tmp_path):
    scans.write_splits(spark.read.parquet(f"{sf}/events.parquet").withColumn("split", F.lit("val")), str(tmp_path / "s"))
    assert "PartitionFilters: [isnotnull(split" in plan(scans.read_split(spark, str(tmp_path / "s"), "val"))


def test_breakdown_is_one_pass(spark, sf):
    text = plan(opstats.breakdown(inputs.detections(spark, sf)))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details


def test_results_do_not_depend_on_the_partitioning(spark, sf):
    j = inputs.judged(spark, sf)
    one, many = j.coalesce(1), j.repartition(13)
    for make in (lambda d: curves.roc_auc(d, "y", "score"), lambda d: curves.best_threshold(d, "y", "score"),
                 lambda d: curves.threshold_grid(d, "y", "score").orderBy("threshold"),
                 lambda d: features.rolling_features(d.select("event_id", "score"), ["event_id"], ["score"]).orderBy("event_id")):
        assert make(one).collect() == make(many).collect()


def test_running_totals_shuffle_rows_once(spark):
    """Sums equal those of a window, whatever the types and nulls; after the range partitioning only per-partition totals move."""
    from rillwatch.errors import DataError
    from rillwatch.ordering import add_running_totals

    rows = spark.range(5000).select((col("id") * 7919 % 5000).alias("k"), F.when(col("id") % 7 > 0, col("id").cast("int")).alias("n"),
                                    (col("id") / 8).alias("d"), F.struct("id").alias("s")).repartition(5)
    made = add_running_totals(rows, [F.desc("k")], {"through": "n", "sum_d": "d", "again": "n"})
    assert made.dtypes[-3:] == [("through", "bigint"), ("sum_d", "double"), ("again", "bigint")] and made.columns[:4] == rows.columns
    over = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"through": F.coalesce(F.sum("n").over(over), F.lit(0)), "sum_d": F.sum("d").over(over)})
    assert made.drop("again").exceptAll(want).count() == 0 and made.filter("through <> again").count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_part") == 1 and plan.count("MapInArrow") == 1  # that of the totals
    assert add_running_totals(rows.limit(0), ["k"], {"through": "n"}).count() == 0
    with pytest.raises(DataError):
        add_running_totals(rows, ["k"], {"x": "s"})


@pytest.mark.parametrize("by", [[], ["who"]])
def test_sliding_limit_of_one_hot_stream(spark, by):
    """All rows in one run of busy intervals, in batches far smaller than the run; null keys are a stream."""
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(6000):
        t += rng.choice([0, 0, 1, 1, 2, 30, 400]) if i % 500 else 5000
        rows.append((i, t * 50_000, rng.choice(["a", None])))
    want, recent = set(), {}
    for i, at, who in sorted(rows, key=lambda r: (r[1], r[0])):
        done = recent.setdefault(who if by else None, [])
        if len(done) < 25 or done[-25] <= at - 60_000_000:
            done.append(at)
            want.add(i)
    df = spark.createDataFrame(rows, "id long, us long, who string").withColumn("ts", F.timestamp_micros("us")).repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = limits.action_limit(df, "ts", "id", 25, 60, by)
        assert {r.id for r in out.filter("executed").collect()} == want and out.count() == 6000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
