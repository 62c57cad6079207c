"""The histogram forest against plain recomputation: draws, splits, votes, limits, weights."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.errors import ModelError
from rillwatch.operators import bagging

FEATURES = ["x", "y", "z", "flat"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (900, 2)), 3)
    z = rng.integers(0, 4, 900)
    label = np.where(x[:, 0] + 0.3 * rng.normal(0, 1, 900) > 0.8, "b", np.where(z == 3, "c", "a"))
    return [(i, float(a), float(b), float(c), 1.0, f" {k}") for i, (a, b, c, k) in enumerate(zip(x[:, 0], x[:, 1], z, label))]


@pytest.fixture(scope="module")
def flows(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, z double, flat double, label string")


def nodes_of(forest):
    out = {}
    for r in forest.trees.collect():
        counts = np.array(r["counts"]).reshape(len(r["ids"]), -1)
        for i, f, b, c in zip(r["ids"], r["feature"], r["bin"], counts):
            assert (r["tree"], i) not in out
            out[r["tree"], i] = (f, b, tuple(c))
    return out


@pytest.fixture(scope="module")
def forest(flows):
    return bagging.train(flows, FEATURES, "label", ["id"], trees=12, depth=7)


def times_drawn(i, tree, seed=42):
    h = hashlib.md5(f"{i}|{seed}".encode()).hexdigest()
    point = ((int(h[:8], 16) + tree * (int(h[8:16], 16) | 1)) % 2 ** 32) / 2 ** 32
    n, upto = 0, math.exp(-1)
    while point >= upto:
        n += 1
        upto += math.exp(-1) / math.factorial(n)
    return n


def test_trees_do_not_depend_on_where_nodes_are_split(flows, forest):
    for local_rows, parts in ((60, 3), (350, 1)):
        again = bagging.train(flows.repartition(parts), FEATURES, "label", ["id"], trees=12, depth=7, local_rows=local_rows)
        assert nodes_of(again) == nodes_of(forest)
        assert again.stats == forest.stats


def test_draws_and_counts(rows, forest):
    nodes = nodes_of(forest)
    for tree in range(12):
        want = dict.fromkeys("abc", 0)
        for r in rows:
            want[r[5].strip()] += times_drawn(r[0], tree)
        assert nodes[tree, 1][2] == tuple(want.values())
    drawn = np.array([times_drawn(i, t) for i in range(900) for t in range(12)])
    assert abs(drawn.mean() - 1) < 0.05 and abs(drawn.var() - 1) < 0.08


def test_every_split_is_the_best_of_its_features(rows, forest):
    """Each node of three trees from its rows again, one split after the other."""
    o, edges, nodes = forest.options, forest.edges, nodes_of(forest)
    weight = dict(zip(forest.classes, o.weights))

    def gini(part):
        held = {c: sum(n for n, r in part if r[5].strip() == c) * weight[c] for c in forest.classes}
        return sum(v * v for v in held.values()) / sum(held.values()) if part else 0.0

    for tree in range(3):
        todo = [(1, [(n, r) for r in rows if (n := times_drawn(r[0], tree))])]
        while todo:
            node, part = todo.pop()
            feature, b, counts = nodes[tree, node]
            size = sum(n for n, _ in part)
            assert sum(counts) == size
            if feature < 0:
                continue
            assert size >= o.min_split and node.bit_length() <= o.depth
            order = bagging.feature_order(tree, np.array([node]), o)[0].tolist()
            best = None
            for start in range(0, 4, o.tried):
                for f in order[start:start + o.tried]:
                    for k, edge in enumerate(edges[f]):
                        left, right = [p for p in part if p[1][1 + f] <= edge], [p for p in part if p[1][1 + f] > edge]
                        if min(sum(n for n, _ in s) for s in (left, right)) >= o.min_leaf:
                            value = round(gini(left) + gini(right), 9)
                            if best is None or value > best[0]:
                                best = (value, f, k)
                if best:
                    break
            assert best[1:] == (feature, b) or best[0] == pytest.approx(round(sum(gini([p for p in part if (p[1][1 + feature] <= edges[feature][b]) == s]) for s in (True, False)), 9), abs=2e-9)
            todo += [(2 * node, [p for p in part if p[1][1 + feature] <= edges[feature][b]]), (2 * node + 1, [p for p in part if p[1][1 + feature] > edges[feature][b]])]


def test_limits(flows):
    grown = bagging.train(flows, FEATURES, "label", ["id"], trees=5, depth=30, min_split=40, min_leaf=9, max_features=None, criterion="entropy")
    for f, _, counts in nodes_of(grown).values():
        assert sum(counts) >= 9 and (f < 0 or sum(counts) >= 40)
    assert all(f != 3 for f, _, _ in nodes_of(grown).values())  # a constant can't be split
    for bad in ({"criterion": "x"}, {"features": []}):
        with pytest.raises(ModelError):
            bagging.train(**{"df": flows, "features": FEATURES, "label": "label", "key": ["id"], **bad})
    with pytest.raises(ModelError):
        bagging.train(flows.limit(0), FEATURES, "label", ["id"])


def walk(nodes, edges, weights, tree, row):
    node = 1
    while nodes[tree, node][0] >= 0:
        f, b, _ = nodes[tree, node]
        node = 2 * node + (row[1 + f] > edges[f][b])
    held = np.array(nodes[tree, node][2]) * weights
    return held / held.sum()


def test_votes(rows, flows, forest, monkeypatch):
    nodes, weights = nodes_of(forest), np.array(forest.options.weights)
    for room in (bagging.MODEL_BYTES, 2_000):  # in one pass and in several
        monkeypatch.setattr(bagging, "MODEL_BYTES", room)
        bag = {r["id"]: r for r in forest.out_of_bag(flows, "label", ["id"]).collect()}
        all_votes = {r["id"]: r for r in forest.predict(flows).collect()}
        right = []
        for r in rows[::3]:
            every = np.mean([walk(nodes, forest.edges, weights, t, r) for t in range(12)], axis=0)
            assert [all_votes[r[0]]["probabilities"][c] for c in forest.classes] == pytest.approx(every.tolist())
            out = [t for t in range(12) if not times_drawn(r[0], t)]
            assert bag[r[0]]["trees"] == len(out)
            if out:
                assert bag[r[0]]["votes"] == pytest.approx(np.mean([walk(nodes, forest.edges, weights, t, r) for t in out], axis=0).tolist())
            else:
                assert bag[r[0]]["votes"] is None and bag[r[0]]["oob_label"] is None
    right = [b["oob_label"] == b["label"] for b in bag.values() if b["trees"]]
    assert forest.stats["oob_score"] == pytest.approx(np.mean(right)) and 0.8 < np.mean(right) < 1


def test_importance_save_load_and_odd_values(spark, flows, forest, tmp_path):
    found = {r["feature"]: r["importance"] for r in forest.importance().collect()}
    assert found["x"] > found["z"] > found["y"] > found["flat"] == 0 and sum(found.values()) == pytest.approx(1)
    forest.save(str(tmp_path / "f"))
    again = bagging.BaggedForest.load(spark, str(tmp_path / "f"))
    odd = flows.limit(20).withColumns({"x": F.when(F.col("id") % 2 == 0, F.col("x")), "y": F.lit(float("nan"))}).withColumn("tree", F.lit("own column"))
    assert again.predict(odd).select("id", "tree", "predicted_label", "confidence").exceptAll(
        forest.predict(odd).select("id", "tree", "predicted_label", "confidence")).count() == 0
    assert forest.predict(odd.limit(0)).count() == 0


def test_weights_decide(flows):
    plain = bagging.train(flows, ["flat"], "label", ["id"], trees=1, bootstrap=False, weights=None).predict(flows.limit(1)).first()
    heavy = bagging.train(flows, ["flat"], "label", ["id"], trees=1, bootstrap=False, weights={"b": 100.0}).predict(flows.limit(1)).first()
    n = {r["label"].strip(): r["count"] for r in flows.groupBy("label").count().collect()}
    assert plain["predicted_label"] == "a" and plain["confidence"] == pytest.approx(n["a"] / 900)
    assert heavy["predicted_label"] == "b" and heavy["confidence"] == pytest.approx(100 * n["b"] / (900 + 99 * n["b"]))


def test_equal_rows_are_held_once(spark, flows, monkeypatch):
    """Rows of the same bins and class are one learning row of a task; draws, trees and votes stay those of every row."""
    few = flows.withColumns({"x": F.floor("z") * 1.0, "y": F.floor("z") % 2.0}).coalesce(1)
    held, dealt = [], bagging._learning_rows
    monkeypatch.setattr(bagging, "_learning_rows", lambda *a: held.append(dealt(*a)) or held[0])
    grown = bagging.train(few, ["x", "y"], "label", ["id"], trees=6)
    assert held[0].count() == few.select("x", "y", "label").distinct().count() and grown.stats["n_samples"] == 900
    nodes, told = nodes_of(grown), few.select("id", F.trim("label").alias("c")).collect()
    for tree in range(6):
        assert nodes[tree, 1][2] == tuple(sum(times_drawn(r.id, tree) for r in told if r.c == c) for c in grown.classes)
    bag = {r["id"]: r["trees"] for r in grown.out_of_bag(few, "label", ["id"]).collect()}
    assert all(bag[i] == sum(not times_drawn(i, t) for t in range(6)) for i in range(0, 900, 7))


@pytest.mark.parametrize("name", ["classified_with_probabilities", "classifier_saved_and_loaded"])
def test_vectors_are_classified_without_a_model_on_the_driver(spark, tmp_path, monkeypatch, name):
    """A model of MLlib lies whole on the driver; on vectors without a pattern it grows with the table."""
    import __spark_entry__ as entry
    from rillwatch.operators import classify
    monkeypatch.setattr(classify, "RandomForestClassifier", None)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 64)], i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = entry.queries()[name](spark, str(tmp_path)).first()
    assert set(found) == {200}


def test_rows_of_closed_ends_are_not_dealt(flows, monkeypatch):
    """Trees whose nodes over the whole table are all done need no rows moved; each level is counted in one pass."""
    dealt, passes = [], []
    grow, level = bagging._grow_small, bagging._level_splits
    monkeypatch.setattr(bagging, "_grow_small", lambda rows, known, o: dealt.append(known) or grow(rows, known, o))
    monkeypatch.setattr(bagging, "_level_splits", lambda *a: passes.append(1) or level(*a))
    short = dict(trees=4, depth=3, max_features=None, oob_score=False)
    split = bagging.train(flows.repartition(3), FEATURES, "label", ["id"], local_rows=1, **short)
    assert not dealt[0]["open"].astype(bool).any() and len(passes) <= 3 and split.trees.count() == 4
    assert nodes_of(split) == nodes_of(bagging.train(flows, FEATURES, "label", ["id"], **short))
    monkeypatch.setattr(bagging, "_HELD_CELLS", 4 * 32 * 3 * 3)  # three nodes a pass
    assert nodes_of(bagging.train(flows, FEATURES, "label", ["id"], local_rows=1, **short)) == nodes_of(split) and len(passes) > 6


def test_rows_go_on_past_short_branches():
    """A deep chain with leaves on every level: walked level by level, rows that have ended stay where they ended."""
    ids = np.array([1] + [i for d in range(1, 14) for i in (2 ** d * 1 + (2 ** d - 2), 2 ** (d + 1) - 1)])
    inner = np.array([i == 2 ** int(i).bit_length() - 1 and i < 2 ** 13 for i in ids])
    tree = bagging.Tree(ids, np.where(inner, 0, -1), np.where(inner, [int(i).bit_length() - 1 for i in ids], -1))
    ends = tree.ids[tree.ends(np.arange(32, dtype=np.uint8).reshape(-1, 1))]
    assert ends.tolist() == [2 ** (k + 2) - 2 if k < 13 else 2 ** 14 - 1 for k in range(32)]


def test_features_are_sent_once_and_plain(flows):
    """Plain numbers reach the tasks as they are; missing ones, of any type, count as 0 there."""
    odd = flows.select("id", "label", *FEATURES).withColumns({"x": F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.col("x")),
                                                             "z": F.when(F.col("id") % 5 > 0, F.col("z").cast("int"))})
    filled = odd.withColumns({"x": F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0)), "z": F.coalesce("z", F.lit(0)).cast("decimal(9,2)")})
    a, b = (bagging.train(f, FEATURES, "label", ["id"], trees=5, depth=6) for f in (odd, filled))
    assert nodes_of(a) == nodes_of(b) and a.stats == b.stats
    found = a.predict(odd)
    assert found.columns[:6] == odd.columns and found.select(*odd.columns).exceptAll(odd).count() == 0
    assert [t for _, t in found.dtypes[:6]] == [t for _, t in odd.dtypes]


def test_kinds_of_wide_rows_are_told_apart_when_hashes_meet(monkeypatch):
    """Rows are compared by a hash of their bytes, and byte by byte where two kinds share one."""
    rows = np.random.default_rng(5).integers(0, 3, (500, 19)).astype(np.uint8)
    rows[250:] = rows[:250]
    rows[:, 4:18] = 1
    for mixed in (bagging._mixed, lambda x: x * np.uint64(0)):
        monkeypatch.setattr(bagging, "_mixed", mixed)
        own, kind = bagging._distinct(rows)
        assert (rows[own][kind] == rows).all() and len(own) == len(np.unique(rows, axis=0)) < 250


def test_edges_without_approximate_percentiles(spark, monkeypatch):
    """Tasks send digests: the edges are exact for few values, near for many, and right where numbers are missing."""
    monkeypatch.setattr(bagging.F, "percentile_approx", None)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 60_000)
    df = spark.createDataFrame([(float(v), None if i % 3 == 0 else i % 7) for i, v in enumerate(x)], "a double, b int").withColumn(
        "c", F.lit(float("nan"))).repartition(5)
    shares = np.arange(1, 32) / 32
    exact = np.sort(x)[np.ceil(shares * len(x)).astype(int) - 1]
    filled = np.sort([0 if i % 3 == 0 else i % 7 for i in range(60_000)])
    few = np.unique(filled[np.ceil(shares * 60_000).astype(int) - 1])
    for digest, rows, sent in ((bagging._DIGEST, bagging._DIGESTED_ROWS, 1 << 20), (5_000, 4_096, 5_000)):
        monkeypatch.setattr(bagging, "_DIGEST", digest)
        monkeypatch.setattr(bagging, "_DIGESTED_ROWS", rows)
        monkeypatch.setattr(bagging, "_SENT", sent)
        a, b, c = bagging._edges(df, ["a", "b", "c"])
        assert b.tolist() == few[few < filled[-1]].tolist() and c.tolist() == []
        ranks = np.searchsorted(np.sort(x), a) - np.searchsorted(np.sort(x), exact)
        assert len(a) == 31 and abs(ranks).max() <= (0 if sent > 60_000 else 60)
