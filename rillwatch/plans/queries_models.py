"""Queries over models and whole jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..core import col, pin, work_path
from ..functions import rules
from ..operators import bagging, classify, clean, detect, forest, opstats, prepare, spread_forest
from . import pipelines
from .inputs import CLASS_SQL, DIRTY, NUMERIC, dirty, spread, table
from .registry import query, rnd, rounded, sql_rnd

_N = list(NUMERIC)
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _z(c):
    return f"abs(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END)"


_FLAGSHIP = f"""
  WITH d AS (SELECT DISTINCT * FROM ({DIRTY})), k AS (SELECT * REPLACE (CASE WHEN isinf(l_extendedprice) THEN 0.0 ELSE l_extendedprice END AS l_extendedprice) FROM d WHERE l_tax IS NOT NULL),
       f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUMERIC)} FROM k),
       z AS (SELECT ({' + '.join(_z(c) for c in NUMERIC)}) / 4 AS s, l_returnflag = 'R' AS zero_day FROM k, f),
       n AS (SELECT (s - lo) / (hi - lo) AS score, zero_day FROM z, (SELECT min(s) AS lo, max(s) AS hi FROM z)),
       v AS (SELECT *, CASE WHEN zero_day THEN round(least(1.0, score + 0.2), 10) ELSE score END AS e FROM n),
       g AS (SELECT *, CASE WHEN e >= 0.9 THEN 'critical' WHEN e >= 0.7 THEN 'high' WHEN e >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM v)
  SELECT severity, count(*) AS flows, count(*) FILTER (zero_day) AS zero_days, {sql_rnd('avg(score)')} AS mean_score, {sql_rnd('max(score)')} AS max_score FROM g GROUP BY severity"""


@query("flagship", _FLAGSHIP)
def flagship(spark, folder):
    """Dirty flows to severity statistics: clean, scale, score, normalise, grade, count."""
    cleaned = pin(clean.clean(dirty(spark, folder)))  # three passes follow: fit, extremes, rows
    scored = forest.normalise(pipelines.score_by_deviation(cleaned, _N).select("raw_score", "l_returnflag"))
    zero_day = col("l_returnflag") == "R"
    graded = scored.withColumn("severity", rules.severity_boosted(col("anomaly_score"), zero_day))
    return rounded(graded.groupBy("severity").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(zero_day).alias("zero_days"), F.avg("anomaly_score").alias("mean_score"),
        F.max("anomaly_score").alias("max_score")))


_PREPARED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("prepared_table", f"""
  WITH d AS (SELECT DISTINCT * FROM ({DIRTY})), k AS (SELECT * REPLACE (CASE WHEN isinf(l_extendedprice) THEN 0.0 ELSE l_extendedprice END AS l_extendedprice) FROM d WHERE l_tax IS NOT NULL),
       f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUMERIC)} FROM k)
  SELECT l_orderkey, l_linenumber, {', '.join(sql_rnd(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END') + f' AS {c}' for c in NUMERIC)},
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag FROM k, f""")
def _(spark, folder):
    return rounded(pipelines.prepare_table(dirty(spark, folder), "l_returnflag", _PREPARED_COLUMNS).table)


@query("prepared_splits", f"""
  WITH s AS (SELECT event_id, event_type, value, CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM events),
       f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM s WHERE split = 'train'),
       c AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM s WHERE split = 'train'))
  SELECT event_id::DOUBLE AS event_id, {sql_rnd('(value - m) / f.s')} AS value, code AS event_type, split FROM s JOIN c USING (event_type), f""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "value", F.when(col("event_id") % 10 < 7, "train")
                                              .when(col("event_id") % 10 < 8, "val").otherwise("test").alias("split"))
    return rounded(pipelines.prepare_splits(e, "event_type", ["value"]).table)


_W = "OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("extracted_features", f"""
  SELECT event_id, event_type, value, user_id, m AS value__rmean, s AS value__rstd, lo AS value__rmin, hi AS value__rmax, um AS user_id__rmean, us AS user_id__rstd, ulo AS user_id__rmin, uhi AS user_id__rmax,
         round(value - user_id, 6) AS value__diff__user_id FROM (
    SELECT event_id, event_type, value, user_id, {sql_rnd(f'avg(value) {_W}')} AS m, {sql_rnd(f'coalesce(stddev_samp(value) {_W}, 0)')} AS s, min(value) {_W} AS lo, max(value) {_W} AS hi,
      {sql_rnd(f'avg(user_id) {_W}')} AS um, {sql_rnd(f'coalesce(stddev_samp(user_id) {_W}, 0)')} AS us, min(user_id) {_W} AS ulo, max(user_id) {_W} AS uhi FROM events) x""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "value", "user_id")
    made, _ = pipelines.engineer_features(e, ["event_id"], "event_type", ["value", "user_id"], transform=False, choose=False)
    wanted = ["event_id", "event_type", "value", "user_id", *[f"{c}__r{f}" for c in ("value", "user_id") for f in ("mean", "std", "min", "max")],
              "value__diff__user_id"]
    return rounded(made.select(*wanted))


@query("engineered_features")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "value", "user_id")
    return pipelines.engineer_features(e, ["event_id"], "event_type", ["value"], n=6)[0]


@query("engineered_splits")
def _(spark, folder):
    e = prepare.add_split(table(spark, folder, "events").select("event_id", "event_type", "value"), ["event_id"], "event_type")
    return pipelines.engineer_splits(e, ["event_id"], "event_type")


# --- isolation forest -----------------------------------------------------------------------------------------------

def _lines(spark, folder):
    return spread(table(spark, folder, "lineitem"))


def _grown(spark, folder, trees=100):
    return forest.fit(_lines(spark, folder), _N, _KEY, trees=trees)


_UNIT = float(forest.mean_path(256))


def _given(spark, folder):
    """Two-level trees split at the column means: small enough to write down in SQL."""
    means = _lines(spark, folder).agg(*[F.round(F.avg(c), 6).alias(c) for c in _N]).first()
    rows = []
    for t in range(4):
        a, b = t, (t + 1) % 4
        rows += [(t, 0, a, means[_N[a]], 1, 2, 0.0), (t, 1, b, means[_N[b]], 3, 4, 0.0), (t, 2, -1, 0.0, -1, -1, 1.0 + t * 0.5),
                 (t, 3, -1, 0.0, -1, -1, 2.0), (t, 4, -1, 0.0, -1, -1, 3.0)]
    nodes = pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "path"])
    return forest.given_nodes(nodes, _N, 256, offset=-0.92, threshold=0.6)


_PATHS = " + ".join(f"CASE WHEN {NUMERIC[t]} <= a{t} THEN CASE WHEN {NUMERIC[(t + 1) % 4]} <= a{(t + 1) % 4} THEN 2.0 ELSE 3.0 END ELSE {1.0 + t * 0.5} END::DOUBLE" for t in range(4))
_GIVEN = f"""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, -pow(2.0, -(({_PATHS}) / 4.0) / {_UNIT!r}) AS raw FROM lineitem, (SELECT {', '.join(f'round(avg({c}), 6) AS a{i}' for i, c in enumerate(NUMERIC))} FROM lineitem) m"""


@query("forest_scores_given_nodes", f"SELECT l_orderkey, l_linenumber, l_quantity, {sql_rnd('raw', 9)} AS raw_score, {sql_rnd('raw + 0.92', 9)} AS decision, CASE WHEN raw + 0.92 < 0 THEN -1 ELSE 1 END AS prediction FROM ({_GIVEN}) g")
def _(spark, folder):
    return rounded(_given(spark, folder).decide(_lines(spark, folder)).select("l_orderkey", "l_linenumber", "l_quantity", "raw_score", "decision", "prediction"), 9)


_NORMAL = f"SELECT *, 1.0 - (raw - lo) / (hi - lo) AS score FROM ({_GIVEN}) g, (SELECT min(raw) AS lo, max(raw) AS hi FROM ({_GIVEN}) h)"


@query("forest_binary_given_nodes", f"SELECT l_orderkey, l_linenumber, l_quantity, {sql_rnd('score')} AS anomaly_score, CAST(score >= 0.6 AS INTEGER) AS prediction FROM ({_NORMAL}) n")
def _(spark, folder):
    return rounded(forest.predict_binary(_lines(spark, folder), _given(spark, folder)).select("l_orderkey", "l_linenumber", "l_quantity", "anomaly_score", "prediction"))


@query("forest_detections_given_nodes", f"""
  SELECT l_orderkey, l_linenumber, l_quantity, {sql_rnd('score')} AS anomaly_score, score > 0.6 AS is_anomaly, {sql_rnd('least(abs(score - 0.6) / 0.6, 1.0)')} AS confidence,
         CASE WHEN score <= 0.6 THEN 'low' WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM ({_NORMAL}) n""")
def _(spark, folder):
    found = forest.detect_anomalies(_lines(spark, folder), _given(spark, folder))
    return rounded(found.select("l_orderkey", "l_linenumber", "l_quantity", "anomaly_score", "is_anomaly", "confidence", "severity"))


@query("forest_fit_and_score")
def _(spark, folder):
    grown = _grown(spark, folder)
    return grown.decide(_lines(spark, folder)).groupBy("l_returnflag", "prediction").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("raw_score")).alias("mean_score"), rnd(F.min("decision")).alias("lowest"))


@query("forest_detector_trained")
def _(spark, folder):
    benign = _lines(spark, folder).filter("l_returnflag = 'N'")
    detector = forest.train_detector(benign, _N, _KEY, trees=50)
    found = forest.detect_anomalies(_lines(spark, folder), detector)
    return found.groupBy("severity", "is_anomaly").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("confidence")).alias("confidence"))


@query("forest_saved_and_loaded", "SELECT count(*) AS rows, count(*) AS equal_scores FROM lineitem")
def _(spark, folder):
    grown, path = _grown(spark, folder, 25), work_path(spark, "forest")
    grown.save(spark, path)
    again = forest.Forest.load(spark, path)
    both = _lines(spark, folder).select(grown.score_column(_lines(spark, folder)).alias("a"), *_N)
    return again.score(both, "b").agg(F.count(F.lit(1)).alias("rows"), F.count_if(col("a") == col("b")).alias("equal_scores"))


#: Nodes of one level of all trees that are broadcast; more are joined by shuffling.
_BROADCAST_NODES = 100_000


def _walked(rows, nodes):
    """(id, path) of each row and tree: one join a level, with the nodes of that level alone."""
    nodes = nodes.withColumn("level", F.length(F.bin("node")))
    levels = nodes.groupBy("level").count().orderBy("level").collect()  # one row a level
    at = rows.crossJoin(F.broadcast(nodes.filter("level = 1").select("tree"))).withColumns({"at": F.lit(1).cast("long"), "path": F.lit(None).cast("double")})
    for r in levels:
        own = nodes.filter(F.col("level") == r["level"])
        own = (F.broadcast(own) if r["count"] <= _BROADCAST_NODES else own).alias("n")
        value = F.element_at(F.array(*[col(c) for c in _N]), F.greatest(F.col("n.feature") + 1, F.lit(1)))
        step = F.when(F.col("n.node").isNull() | (F.col("n.feature") < 0), F.col("at")).when(value <= F.col("n.split"), F.col("n.left")).otherwise(F.col("n.right"))
        at = at.alias("r").join(own, (F.col("r.tree") == F.col("n.tree")) & (F.col("r.at") == F.col("n.node")), "left").select(
            "id", *_N, F.col("r.tree").alias("tree"), step.alias("at"), F.when(F.col("n.feature") < 0, F.col("n.path")).otherwise(F.col("r.path")).alias("path"))
    return at.select("id", "path")


@query("forest_of_whole_table", "SELECT t::INT AS tree, (SELECT count(*) FROM lineitem) AS rows_in_leaves, (SELECT count(*) FROM lineitem) AS rows_at_root FROM (SELECT unnest(range(40)) AS t) u")
def _(spark, folder):
    """Forty trees of all rows: each row is in one leaf of each tree."""
    lines = _lines(spark, folder)
    rows = lines.count()
    nodes = spread_forest.fit_spread(lines, _N, _KEY, 40, rows, rows, len(_N), False, 42, pinned=False).node_table()
    return nodes.groupBy("tree").agg(F.sum(F.when(col("feature") < 0, col("size"))).alias("rows_in_leaves"), F.max(F.when(col("node") == 1, col("size"))).alias("rows_at_root"))


@query("forest_walked_by_joins", "SELECT count(*) AS rows, count(*) AS equal_scores FROM lineitem")
def _(spark, folder):
    """Two trees of all rows, split over the table down to 20,000 rows a node: scores against a walk in joins over the node table.

    Rows with the same numbers walk the same way, so they walk once, with their number.
    """
    rows = pin(_lines(spark, folder).groupBy(*_N).agg(F.count(F.lit(1)).alias("alike")).withColumn("id", F.monotonically_increasing_id()))
    n = rows.agg(F.sum("alike")).first()[0]
    grown = spread_forest.fit_spread(rows, _N, [], 2, n, n, len(_N), False, 42, local_rows=20_000, alike="alike")
    paths = _walked(rows.select("id", *_N), grown.node_table()).groupBy("id").agg(F.avg("path").alias("mean"))
    unit = float(forest.mean_path(n))
    both = grown.score(rows).select("id", "alike", "raw_score").join(paths, "id")
    equal = F.abs(col("raw_score") + F.pow(F.lit(2.0), -col("mean") / unit)) < 1e-9
    return both.agg(F.sum("alike").alias("rows"), F.sum(F.when(equal, col("alike")).otherwise(0)).alias("equal_scores"))


# --- classifier -----------------------------------------------------------------------------------------------------

_LABEL = "label"


def _vectors(spark, folder):
    """Embeddings as flows: all dimensions, the label as class name."""
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", *[col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_X)],
                    F.concat(F.lit("class_"), col("label").cast("string")).alias(_LABEL))


_X = [f"x{i}" for i in range(64)]

# Events whose class each of three features determines: whatever forest is grown, its answers are known.
_CODE = "CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
_TOLD = f"(SELECT event_id, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, {_CODE} AS code, {CLASS_SQL} AS label FROM events)"
_TOLD_X = ["a", "b", "c"]


def _told(spark, folder):
    e = _events(spark, folder).join(table(spark, folder, "events").select("event_id", F.expr(_CODE).alias("code")), "event_id")
    return e.withColumns({"a": col("code") * 10.0, "b": col("code") * 2 % 5 * 1.0, "c": -col("code") * 1.0}).drop("code").withColumnRenamed("Label", _LABEL)


def _told_classifier(spark, folder):
    return bagging.train(_told(spark, folder), _TOLD_X, _LABEL, ["event_id"], oob_score=False)


@query("class_weights", """SELECT label, n, round(total / (classes * n)::DOUBLE, 9) AS weight FROM (
  SELECT 'class_' || label AS label, count(*) AS n, (SELECT count(*) FROM embeddings) AS total, (SELECT count(DISTINCT label) FROM embeddings) AS classes FROM embeddings GROUP BY 1) x""")
def _(spark, folder):
    return rounded(classify.class_weights(_vectors(spark, folder), _LABEL), 9)


@query("classified_rows", f"SELECT event_id, label, label AS predicted_label, code AS predicted_code, 1.0::DOUBLE AS confidence FROM {_TOLD} t")
def _(spark, folder):
    found = _told_classifier(spark, folder).predict(_told(spark, folder))
    return found.select("event_id", _LABEL, "predicted_label", "predicted_code", rnd("confidence").alias("confidence"))


@query("classified_with_probabilities", "SELECT count(*) AS rows, count(*) AS sums_to_one, count(*) AS confident_in_label FROM embeddings")
def _(spark, folder):
    v = _vectors(spark, folder)
    p = bagging.train(v, _X, _LABEL, ["vec_id"], weights={"class_1": 3.0}, oob_score=False).predict(v)
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda s, x: s + x)
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                 F.count_if(F.abs(F.element_at("probabilities", col("predicted_label")) - col("confidence")) < 1e-12).alias("confident_in_label"))


@query("classifier_validated", f"""
  WITH v AS (SELECT label, count(*) AS n FROM {_TOLD} t WHERE event_id % 10 >= 7 GROUP BY label)
  SELECT label AS class, n AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, CAST((SELECT sum(n) FROM v) - n AS BIGINT) AS tn, n AS support, 1.0::DOUBLE AS precision,
         1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score FROM v""")
def _(spark, folder):
    v = _told(spark, folder)
    report = classify.train_with_validation(v.filter("event_id % 10 < 7"), _TOLD_X, _LABEL, v.filter("event_id % 10 >= 7"))[1]
    return rounded(report)


# One feature that determines the class, one that is the same everywhere.
def _plain(spark, folder):
    return _told(spark, folder).withColumn("flat", F.lit(0.0))


@query("classifier_importance", "SELECT * FROM (VALUES ('a', 1.0::DOUBLE, 1), ('flat', 0.0::DOUBLE, 2)) v(feature, importance, rank)")
def _(spark, folder):
    return rounded(classify.train(_plain(spark, folder), ["a", "flat"], _LABEL).importance())


@query("classifier_importance_by_class", f"""SELECT v.*, class FROM (VALUES ('a', 1.0::DOUBLE, 1), ('flat', 0.0::DOUBLE, 2)) v(feature, importance, rank),
  (SELECT DISTINCT label AS class FROM {_TOLD} t) c""")
def _(spark, folder):
    return rounded(classify.train(_plain(spark, folder), ["a", "flat"], _LABEL).importance_by_class())


@query("permutation_importance", f"""
  WITH s AS (SELECT unnest(range(42, 52)) AS seed),
       x AS (SELECT seed, label, row_number() OVER (PARTITION BY seed ORDER BY event_id) AS i FROM {_TOLD} t, s),
       y AS (SELECT seed, label, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(event_id AS VARCHAR) || '|' || seed)) AS i FROM {_TOLD} t, s),
       l AS (SELECT seed, 1.0 - avg((x.label = y.label)::INT) AS loss FROM x JOIN y USING (seed, i) GROUP BY seed)
  SELECT 'a' AS feature, {sql_rnd('avg(loss)')} AS importance_mean, {sql_rnd('stddev_pop(loss)')} AS importance_std, 1 AS rank FROM l
  UNION ALL SELECT 'flat', 0.0, 0.0, 2""")
def _(spark, folder):
    v = _plain(spark, folder)
    grown = bagging.train(v, ["a", "flat"], _LABEL, ["event_id"], oob_score=False)
    return rounded(classify.permutation_importance(v, grown, _LABEL, ["event_id"]))


@query("permuted_column", """
  WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
       b AS (SELECT label, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '|7')) AS i FROM embeddings)
  SELECT vec_id, 'class_' || label AS p FROM a JOIN b USING (i)""")
def _(spark, folder):
    v = _vectors(spark, folder).select("vec_id", _LABEL)
    return classify.permuted(v, [_LABEL], ["vec_id"], 7).select("vec_id", col("_p_label").alias("p"))


@query("classifier_saved_and_loaded", "SELECT count(*) AS rows, count(*) AS equal_labels FROM embeddings")
def _(spark, folder):
    v, path = _vectors(spark, folder), work_path(spark, "classifier")
    model = bagging.train(v, _X, _LABEL, ["vec_id"], oob_score=False)
    model.save(path)
    again = bagging.BaggedForest.load(spark, path).predict(v.drop(_LABEL)).select("vec_id", col("predicted_label").alias("b"))
    both = model.predict(v).select("vec_id", col("predicted_label").alias("a")).join(again, "vec_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(col("a") == col("b")).alias("equal_labels"))


# --- forest from histograms ---------------------------------------------------------------------------------------------

@query("forest_out_of_bag", f"""
  WITH h AS (SELECT event_id, label, md5(event_id || '|42') AS h FROM {_TOLD} t),
       d AS (SELECT event_id, label, ('0x' || substr(h, 1, 8))::BIGINT AS lot, ('0x' || substr(h, 9, 8))::BIGINT | 1 AS step FROM h),
       v AS (SELECT event_id, label, count(*) FILTER (((lot + t * step) % 4294967296)::DOUBLE / 4294967296.0 < exp(-1)) AS trees
             FROM d, (SELECT unnest(range(150)) AS t) u GROUP BY ALL)
  SELECT event_id, trees::INT AS trees, CASE WHEN trees > 0 THEN label END AS oob_label FROM v""")
def _(spark, folder):
    """Which trees never drew a row, and what they say of it."""
    told = _told(spark, folder)
    grown = bagging.train(told, _TOLD_X, _LABEL, ["event_id"], oob_score=False)
    return grown.out_of_bag(told, _LABEL, ["event_id"]).select("event_id", "trees", "oob_label")


_STUMP_WEIGHTS = {"Heartbleed": 4.0, "BENIGN": 0.5, "DoS Hulk": 1.5}
_STUMP = f"""
  WITH c AS (SELECT label, code, count(*) * CASE label WHEN 'Heartbleed' THEN 4.0 WHEN 'BENIGN' THEN 0.5 WHEN 'DoS Hulk' THEN 1.5 ELSE 1.0 END::DOUBLE AS v FROM {_TOLD} t GROUP BY label, code),
       s AS (SELECT t, (SELECT sum(v * v) / sum(v) FROM c WHERE code <= t) + (SELECT sum(v * v) / sum(v) FROM c WHERE code > t) AS q FROM (SELECT unnest(range(4)) AS t) u),
       b AS (SELECT t FROM s ORDER BY round(q, 9) DESC, t LIMIT 1),
       p AS (SELECT code <= t AS side, label, v / sum(v) OVER (PARTITION BY code <= t) AS share FROM c, b),
       w AS (SELECT side, arg_max(label, share) AS predicted_label, max(share) AS confidence, coalesce(max(share) FILTER (label = 'Heartbleed'), 0.0) AS heartbleed FROM p GROUP BY side)"""


@query("stump_with_class_weights", f"""{_STUMP}
  SELECT event_id, predicted_label, {sql_rnd('confidence')} AS confidence, {sql_rnd('heartbleed')} AS heartbleed FROM {_TOLD} t, b JOIN w ON w.side = (t.code <= b.t)""")
def _(spark, folder):
    """One split on one feature: which one is best, and what its sides say, depends on the weights."""
    coded = _told(spark, folder).withColumn("code", -col("c"))
    grown = bagging.train(coded, ["code"], _LABEL, ["event_id"], trees=1, depth=1, bootstrap=False, weights=_STUMP_WEIGHTS)
    found = grown.predict(coded)
    return rounded(found.select("event_id", "predicted_label", "confidence", F.element_at("probabilities", "Heartbleed").alias("heartbleed")))


@query("stump_split_bound", f"""
  WITH n AS (SELECT label, count(*) AS n FROM {_TOLD} t GROUP BY label), b AS (SELECT label, n FROM n ORDER BY n DESC, label LIMIT 1)
  SELECT event_id, b.label AS predicted_label, {sql_rnd('b.n / (SELECT sum(n) FROM n)')} AS confidence FROM {_TOLD} t, b""")
def _(spark, folder):
    """A tree that needs more rows for a split than there are stays one leaf: the class shares of all rows."""
    told = _told(spark, folder)
    grown = bagging.train(told, _TOLD_X, _LABEL, ["event_id"], trees=1, bootstrap=False, weights=None, min_split=told.count() + 1)
    return rounded(grown.predict(told).select("event_id", "predicted_label", "confidence"))


# Thirty features of a line, and a class that four of them decide.
_WIDE_CLASS = """CASE WHEN l_quantity > 30 AND l_discount > 0.045 THEN 'DoS Hulk' WHEN l_tax > 0.055 THEN 'DoS GoldenEye'
    WHEN l_extendedprice > 60000 THEN 'DoS Slowloris' ELSE 'BENIGN' END"""


def wide_flows(spark, folder):
    """Thirty numeric features a line, and its class."""
    n = {"q": col("l_quantity"), "e": col("l_extendedprice") / 1000, "d": col("l_discount") * 100, "t": col("l_tax") * 100,
         "n": col("l_linenumber").cast("double"), "p": F.pmod("l_partkey", F.lit(97)).cast("double"), "s": F.pmod("l_suppkey", F.lit(31)).cast("double")}
    pairs = [(a, b) for i, a in enumerate(n) for b in list(n)[i + 1:]]
    made = dict(n) | {f"{a}_{b}": n[a] * 3 - n[b] for a, b in pairs} | {"day": F.dayofyear("l_shipdate").cast("double"), "flat": F.lit(1.0)}
    return _lines(spark, folder).select(*[c.alias(k) for k, c in made.items()], *_KEY, F.expr(_WIDE_CLASS).alias(_LABEL)), list(made)


@query("classified_wide_flows", f"SELECT label, count(*) AS rows, TRUE AS mostly_right, TRUE AS out_of_bag_agrees FROM (SELECT {_WIDE_CLASS} AS label FROM lineitem) x GROUP BY label")
def _(spark, folder):
    """150 trees over thirty features: at least 97 % of each class right, and an out-of-bag score within two points of that of all rows."""
    flows, features = wide_flows(spark, folder)
    grown = bagging.train(flows, features, _LABEL, _KEY)
    found = grown.predict(flows).withColumn("right", (col("predicted_label") == col(_LABEL)).cast("int"))
    whole = found.select("right", _LABEL).groupBy(_LABEL).agg(F.count(F.lit(1)).alias("rows"), F.sum("right").alias("right"))
    share = F.sum("right").over(Window.partitionBy()) / F.sum("rows").over(Window.partitionBy())  # one row per class
    return whole.select(_LABEL, "rows", (col("right") >= 0.97 * col("rows")).alias("mostly_right"),
                        (F.abs(share - grown.stats["oob_score"]) < 0.02).alias("out_of_bag_agrees"))


# --- two stages -----------------------------------------------------------------------------------------------------

def _events(spark, folder):
    from .inputs import event_class
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", "ts", "user_id", "value", k.alias("k"), event_class().alias("Label"))


def models(spark, folder):
    e = _events(spark, folder)
    return (forest.fit(e, ["value", "k"], ["event_id"], trees=25),
            classify.train(e, ["value", "k"], "Label", trees=8, depth=4))


def _detector():
    """A forest of two written-out trees over value and k."""
    rows = []
    for t in range(2):
        rows += [(t, 0, t, (30.0, 40.0)[t], 1, 2, 0.0), (t, 1, 1 - t, (40.0, 30.0)[t], 3, 4, 0.0), (t, 2, -1, 0.0, -1, -1, 1.0 + t * 0.5),
                 (t, 3, -1, 0.0, -1, -1, 2.0), (t, 4, -1, 0.0, -1, -1, 3.0)]
    nodes = pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "path"])
    return forest.given_nodes(nodes, ["value", "k"], 256, offset=-0.88, threshold=0.6)


_TWO_STAGE = f"""
  WITH p AS (SELECT *, (CASE WHEN value <= 30.0 THEN CASE WHEN k <= 40.0 THEN 2.0 ELSE 3.0 END ELSE 1.0 END::DOUBLE
                        + CASE WHEN k <= 40.0 THEN CASE WHEN value <= 30.0 THEN 2.0 ELSE 3.0 END ELSE 1.5 END::DOUBLE) / 2.0 AS path FROM {_TOLD} t),
       d AS (SELECT *, -pow(2.0, -path / {_UNIT!r}) + 0.88 AS decision FROM p),
       z AS (SELECT *, decision < 0 AS is_anomaly, 1.0 / (1.0 + exp(decision)) AS anomaly_score, decision < 0 AND label = 'BENIGN' AS is_zero_day FROM d),
       found AS (SELECT event_id, 'user_' || user_id AS sample_id, is_anomaly, anomaly_score, is_zero_day,
                        CASE WHEN is_zero_day THEN 'ZERO_DAY' WHEN is_anomaly THEN label ELSE 'BENIGN' END AS predicted_class, 1.0::DOUBLE AS classification_confidence,
                        CASE WHEN anomaly_score >= 0.9 OR is_zero_day THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high'
                             WHEN anomaly_score >= 0.5 THEN 'medium' ELSE 'low' END AS severity, label FROM z)"""


def _two_stages(spark, folder):
    return detect.detect(_told(spark, folder), _detector(), _told_classifier(spark, folder), F.concat(F.lit("user_"), col("user_id").cast("string")))


@query("two_stage_detections", f"""{_TWO_STAGE}
  SELECT 'total' AS breakdown, '' AS key, count(*) AS n, count(*) FILTER (is_zero_day) AS zero_days FROM found
  UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (is_zero_day) FROM found GROUP BY severity
  UNION ALL SELECT 'class', predicted_class, count(*), count(*) FILTER (is_zero_day) FROM found GROUP BY predicted_class""")
def _(spark, folder):
    return rounded(opstats.breakdown(_two_stages(spark, folder)))


@query("two_stage_rows", f"""{_TWO_STAGE}
  SELECT event_id, sample_id, is_anomaly, {sql_rnd('anomaly_score')} AS anomaly_score, is_zero_day, predicted_class, classification_confidence, severity FROM found""")
def _(spark, folder):
    return rounded(_two_stages(spark, folder).select("event_id", "sample_id", "is_anomaly", "anomaly_score", "is_zero_day", "predicted_class",
                                                     "classification_confidence", "severity"))


@query("two_stage_fitted")
def _(spark, folder):
    detector, classifier = models(spark, folder)
    found = detect.detect(_events(spark, folder), detector, classifier, F.concat(F.lit("user_"), col("user_id").cast("string")))
    return rounded(opstats.breakdown(found))


@query("two_stage_without_classifier", """SELECT count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS errors, TRUE AS all_zero_day FROM events""")
def _(spark, folder):
    e = _events(spark, folder).withColumn("value", F.when(col("event_id") % 50 != 0, col("value")))
    detector = forest.fit(e.na.drop(), ["value", "k"], ["event_id"], trees=20)
    found = detect.detect(e, detector, None, col("event_id"))
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_if(col("predicted_class") == "ERROR").alias("errors"),
                     F.bool_and(col("is_anomaly") == col("is_zero_day")).alias("all_zero_day"))


@query("flagged_rows_classified", f"SELECT event_id, CASE WHEN value > 60 THEN label ELSE 'BENIGN' END AS final_label FROM {_TOLD} t")
def _(spark, folder):
    e = _told(spark, folder).withColumn("flag", col("value") > 60)
    return detect.classify_flagged(e, "flag", _told_classifier(spark, folder)).select("event_id", "final_label")


@query("model_reports", f"""{_TWO_STAGE},
  j AS (SELECT (label <> 'BENIGN')::INT AS t, is_anomaly::INT AS p FROM found),
  c AS (SELECT cls, count(*) FILTER (t = cls AND p = cls) AS tp, count(*) FILTER (t <> cls AND p = cls) AS fp, count(*) FILTER (t = cls AND p <> cls) AS fn FROM j, (SELECT unnest([0, 1]) AS cls) u GROUP BY cls),
  f AS (SELECT tp + fn AS support, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END AS f1 FROM c)
  SELECT 'anomaly_detection_evaluation' AS experiment_name, {sql_rnd('(SELECT avg((t = p)::INT) FROM j)')} AS accuracy, {sql_rnd('sum(f1 * support) / sum(support)')} AS f1_score,
         (SELECT count(*) FROM j) AS total_samples, 2 AS classes FROM f
  UNION ALL SELECT 'classification_evaluation', 1.0, 1.0, count(*), count(DISTINCT label)::INT FROM found""")
def _(spark, folder):
    r = pipelines.model_reports(_told(spark, folder), _LABEL, _detector(), _told_classifier(spark, folder))
    return rounded(r.select("experiment_name", "summary.accuracy", "summary.f1_score", "summary.total_samples", F.size("per_class").alias("classes")))


@query("backtest_report", f"""{_TWO_STAGE},
  w AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS w, ((label <> 'BENIGN') = is_anomaly)::INT AS ok FROM found),
  a AS (SELECT count(*) AS n, avg(ok) AS accuracy FROM w GROUP BY w)
  SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) AS windows, {sql_rnd('(SELECT avg(ok) FROM w)')} AS accuracy, {sql_rnd('min(accuracy)')} AS worst_window FROM a""")
def _(spark, folder):
    from ..operators.curves import backtest
    e = _events(spark, folder)
    judged = _detector().decide(e).select("event_id", clean.binary_label(col("Label")).alias("y"), (col("prediction") == -1).cast("int").alias("flag"))
    windows = backtest(judged, ["event_id"], "y", "flag", 100)
    return rounded(windows.agg(F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("windows"),
                               ((F.sum("tp") + F.sum("tn")) / F.sum("samples")).alias("accuracy"), F.min("accuracy").alias("worst_window")))
