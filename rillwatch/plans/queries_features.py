"""Queries over profiles, validation, features and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import col
from ..operators import features, neighbours, profile, select, validate
from .inputs import DIRTY, FLOWS, NUMERIC, dirty, flows, table
from .registry import query, rounded, sql_rnd

_N = list(NUMERIC)


@query("profile_summary", f"""
  WITH d AS ({DIRTY}), l AS (SELECT l_returnflag, count(*) AS n FROM d GROUP BY ALL), u AS (SELECT DISTINCT * FROM d)
  SELECT (SELECT count(*) FROM d) AS rows, 7 AS columns, 6 AS features, (SELECT count(*) - count(l_tax) FROM d) AS total_missing,
         (SELECT count(*) FROM d) - (SELECT count(*) FROM u) AS duplicates, count(*) AS unique_labels,
         round(max(n) / min(n), 2) AS class_imbalance_ratio FROM l""")
def _(spark, folder):
    return profile.table_summary(dirty(spark, folder), "l_returnflag")


@query("profile_columns", " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", count({c}) AS n, {sql_rnd(f'avg({c})', 5)} AS mean, {sql_rnd(f'stddev_samp({c})', 5)} AS std, min({c}) AS min,
    {', '.join(sql_rnd(f'quantile_cont({c}, {q / 100})', 5) + f' AS q{q}' for q in (25, 50, 75))}, max({c}) AS max FROM lineitem""" for c in NUMERIC))
def _(spark, folder):
    return rounded(profile.describe(flows(spark, folder), _N), 5)


@query("class_distribution", """
  SELECT event_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE * 100, 2) AS percentage,
         event_type = 'view' AS is_benign, event_type IN ('click', 'error') AS is_known_attack FROM events GROUP BY event_type""")
def _(spark, folder):
    return profile.class_distribution(table(spark, folder, "events"), "event_type", "view", ["click", "error"])


_RELATED = """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + l_tax AS double_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem"""
_RELATED_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "double_quantity", "net"]


def _related(spark, folder):
    return table(spark, folder, "lineitem").select(
        *_N, (col("l_quantity") * 2 + col("l_tax")).alias("double_quantity"),
        (col("l_extendedprice") * (F.lit(1) - col("l_discount"))).alias("net"))


def _corr(pairs):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM d" for a, b in pairs)


_UPPER = [(a, b) for i, a in enumerate(_RELATED_NAMES) for b in _RELATED_NAMES[i + 1:]]


@query("correlation_matrix", f"WITH d AS ({_RELATED}), p AS ({_corr([(a, b) for a in _RELATED_NAMES for b in _RELATED_NAMES])}) SELECT a, b, {sql_rnd('r')} AS r FROM p")
def _(spark, folder):
    return rounded(profile.correlation_matrix(_related(spark, folder)))


@query("embedding_correlations", f"""
  WITH l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT 'x' || p.i AS a, 'x' || q.i AS b, {sql_rnd('corr(p.v, q.v)')} AS r FROM l p JOIN l q ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY p.i, q.i""")
def _(spark, folder):
    """All pairs of 64 columns in one scan."""
    e = table(spark, folder, "embeddings")
    wide = e.select(*[col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    return rounded(profile.correlation_pairs(wide, wide.columns))


@query("high_correlations", f"WITH d AS ({_RELATED}), p AS ({_corr(_UPPER)}) SELECT a, b, round(abs(r), 4) AS r FROM p WHERE abs(r) >= 0.9")
def _(spark, folder):
    return profile.highly_correlated(_related(spark, folder), 0.9)


@query("validated_structure", "SELECT 'error' AS level, 'label_missing' AS \"check\", 'Label' AS subject, 0.0::DOUBLE AS value FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, folder):
    return validate.check_structure(flows(spark, folder))


_LABEL_FINDINGS = """
  SELECT 'info' AS level, 'label_count' AS "check", event_type AS subject, count(*)::DOUBLE AS value FROM events GROUP BY event_type
  UNION ALL SELECT 'warning', 'label_unexpected', event_type, count(*)::DOUBLE FROM events WHERE event_type NOT IN ('login', 'click', 'scan') GROUP BY event_type
  UNION ALL SELECT CASE WHEN w = 'login' THEN 'error' ELSE 'warning' END, CASE WHEN w = 'login' THEN 'benign_absent' ELSE 'attack_absent' END, w, 0.0
    FROM (SELECT unnest(['login', 'click', 'scan']) AS w) WHERE w NOT IN (SELECT event_type FROM events)"""


@query("validated_labels", _LABEL_FINDINGS)
def _(spark, folder):
    return validate.check_labels(table(spark, folder, "events"), "event_type", "login", ["click", "scan"])


_FEATURE_FINDINGS = f"""
  SELECT 'error' AS level, 'column_missing' AS "check", 'Flow Duration' AS subject, 0.0::DOUBLE AS value
  UNION ALL SELECT CASE WHEN s > 50 THEN 'error' ELSE 'warning' END, 'missing_share', 'l_tax', round(s, 6) FROM
    (SELECT (count(*) - count(l_tax)) / count(*)::DOUBLE * 100 AS s FROM ({DIRTY})) WHERE s > 10
  UNION ALL SELECT 'warning', 'infinite', 'l_extendedprice', n::DOUBLE FROM (SELECT count(*) AS n FROM ({DIRTY}) WHERE isinf(l_extendedprice)) WHERE n > 0"""


@query("validated_features", _FEATURE_FINDINGS)
def _(spark, folder):
    return rounded(validate.check_features(dirty(spark, folder), ["l_quantity", "l_tax", "l_extendedprice", "Flow Duration"]))


_QUALITY_FINDINGS = f"""
  SELECT 'error' AS level, 'column_empty' AS "check", 'nothing' AS subject, 100.0::DOUBLE AS value FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0
  UNION ALL SELECT CASE WHEN s > 30 THEN 'error' ELSE 'warning' END, 'duplicate_rows', '', round(s, 6) FROM (
    SELECT ((SELECT count(*) FROM ({DIRTY})) - count(*)) * 100.0::DOUBLE / (SELECT count(*) FROM ({DIRTY})) AS s FROM (SELECT DISTINCT * FROM ({DIRTY}))) WHERE s > 5"""


@query("validated_quality", _QUALITY_FINDINGS)
def _(spark, folder):
    return rounded(validate.check_quality(dirty(spark, folder).withColumn("nothing", F.lit(None).cast("string"))))


@query("validated_all", f"""
  SELECT 'info' AS level, 'label_count' AS "check", l_returnflag AS subject, count(*)::DOUBLE AS value FROM ({DIRTY}) GROUP BY l_returnflag
  UNION ALL SELECT 'warning', 'label_unexpected', l_returnflag, count(*)::DOUBLE FROM ({DIRTY}) WHERE l_returnflag = 'R' GROUP BY l_returnflag
  UNION ALL {_FEATURE_FINDINGS}
  UNION ALL {_QUALITY_FINDINGS[_QUALITY_FINDINGS.index('UNION ALL') + 9:]}""")
def _(spark, folder):
    return rounded(validate.check_all(dirty(spark, folder), "l_returnflag", True, "N", ["A"],
                                      ["l_quantity", "l_tax", "l_extendedprice", "Flow Duration"]))


@query("feature_schema", """
  SELECT f.*, (SELECT count(*) FROM lineitem) AS rows FROM (VALUES ('error', 'feature_missing', 'Flow Duration', 0.0::DOUBLE), ('warning', 'feature_extra', 'l_discount', 0.0),
    ('warning', 'feature_extra', 'l_extendedprice', 0.0), ('warning', 'feature_extra', 'l_returnflag', 0.0), ('error', 'not_numeric', 'l_returnflag', 0.0),
    ('info', 'expected_count', '', 3.0), ('info', 'actual_count', '', 5.0), ('info', 'missing_count', '', 1.0), ('info', 'extra_count', '', 3.0)) f(level, "check", subject, value)""")
def _(spark, folder):
    f = flows(spark, folder)
    total = f.agg(F.count(F.lit(1)).alias("rows"))
    return validate.check_feature_schema(f, ["l_quantity", "l_tax", "Flow Duration"]).withColumn("rows", total.scalar())


@query("feature_values", f"""
  SELECT 'warning' AS level, 'missing' AS "check", 'l_tax' AS subject, count(*)::DOUBLE AS value FROM ({DIRTY}) WHERE l_tax IS NULL
  UNION ALL SELECT 'error', 'infinite', 'l_extendedprice', count(*)::DOUBLE FROM ({DIRTY}) WHERE isinf(l_extendedprice)
  UNION ALL SELECT 'warning', 'out_of_range', c, n FROM (
    SELECT 'l_extendedprice' AS c, count(*) FILTER (l_extendedprice > 50000)::DOUBLE AS n FROM ({DIRTY}) UNION ALL
    SELECT 'l_quantity', count(*) FILTER (l_quantity > 50000)::DOUBLE FROM ({DIRTY})) WHERE n > 0""")
def _(spark, folder):
    d = dirty(spark, folder).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return validate.check_feature_values(d, -1e10, 50000.0)


@query("flawless_rows", f"{FLOWS}")
def _(spark, folder):
    f = flows(spark, folder)
    validate.require_columns(f, NUMERIC, ["l_returnflag"])
    return validate.flawless(f)


@query("variance_ranking", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_rnd(f'var_samp({c})', 4)} AS variance FROM lineitem" for c in NUMERIC) + ") ORDER BY variance DESC LIMIT 2")
def _(spark, folder):
    f = flows(spark, folder)
    return rounded(profile.variance_table(f, profile.top_by_variance(f, 2)), 4)


# --- features -------------------------------------------------------------------------------------------------------

_COST = "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"


def _ratio(a, b):
    return f"coalesce({a} / NULLIF({b}, 0.0), 0.0)"


@query("ratio_features", "SELECT " + ", ".join(NUMERIC + [
    f"{sql_rnd(_ratio(a, b))} AS {a}__ratio__{b}" for a in ("l_quantity", "l_extendedprice") for b in ("l_discount", "l_tax")]) + " FROM lineitem")
def _(spark, folder):
    return rounded(features.ratio_features(flows(spark, folder).select(*_N), _N[:2], _N[2:]))


@query("direction_ratios", f"SELECT l_quantity, l_discount, {sql_rnd(_ratio('l_quantity', 'l_discount'))} AS l_quantity__ratio__l_discount FROM lineitem")
def _(spark, folder):
    return rounded(features.direction_ratios(flows(spark, folder).select("l_quantity", "l_discount"),
                                             [("l_quantity", "l_discount"), ("l_quantity", "absent")]))


_NEAR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"),
         ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("difference_features", "SELECT " + ", ".join(NUMERIC + [f"{sql_rnd(f'{a} - {b}')} AS {a}__diff__{b}" for a, b in _NEAR]) + " FROM lineitem")
def _(spark, folder):
    return rounded(features.difference_features(flows(spark, folder).select(*_N)))


_BY_VARIANCE = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_TOP_PAIRS = [(a, b) for i, a in enumerate(_BY_VARIANCE) for b in _BY_VARIANCE[i + 1:i + 3]]
_OPS = {"multiply": "{a} * {b}", "divide": "coalesce({a} / NULLIF({b}, 0.0), 0.0)", "add": "{a} + {b}", "subtract": "{a} - {b}"}


@query("interaction_features", "SELECT " + ", ".join(NUMERIC + [
    f"{sql_rnd(t.format(a=a, b=b), 7)} AS {a}__{op}__{b}" for a, b in _TOP_PAIRS for op, t in _OPS.items()]) + " FROM lineitem")
def _(spark, folder):
    return rounded(features.interaction_features(flows(spark, folder).select(*_N), operations=list(_OPS)), 7)


@query("row_statistics", """
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, round(list_avg(v), 6) AS row_mean, round(list_stddev_samp(v), 6) AS row_std,
         list_max(v) AS row_max, list_min(v) AS row_min, round(list_median(v), 6) AS row_median FROM (
    SELECT l_quantity, l_extendedprice, l_discount, NULLIF(l_tax, 0.0) AS l_tax,
           [x for x in [l_quantity, l_extendedprice, l_discount, NULLIF(l_tax, 0.0)] if x IS NOT NULL] AS v FROM lineitem)""")
def _(spark, folder):
    f = flows(spark, folder).select("l_quantity", "l_extendedprice", "l_discount", F.nullif(col("l_tax"), F.lit(0.0)).alias("l_tax"))
    return rounded(features.row_statistics(f))


@query("log_features", """
  SELECT round(ln(1 + l_quantity + 1.0 - 1.0), 6) AS l_quantity,
         round(ln(1 + b + CASE WHEN lo < 0 THEN abs(lo) + 1.0 ELSE 1.0 END - 1.0), 6) AS balance
  FROM (SELECT l_quantity, l_discount - 0.05 AS b FROM lineitem), (SELECT min(l_discount - 0.05) AS lo FROM lineitem)""")
def _(spark, folder):
    f = table(spark, folder, "lineitem").select("l_quantity", (col("l_discount") - 0.05).alias("balance"))
    return rounded(features.log_features(f))


@query("transformed_features", f"""
  SELECT * FROM (SELECT {', '.join(sql_rnd(f'ln(1 + {c})') + f' AS {c}' for c in ('l_quantity', 'l_discount', 'row_mean', 'row_max', 'row_min', 'ld'))} FROM (
    SELECT *, (l_quantity + l_discount + ld) / 3 AS row_mean, greatest(l_quantity, l_discount, ld) AS row_max, least(l_quantity, l_discount, ld) AS row_min
    FROM (SELECT l_quantity, l_discount, l_quantity * l_discount AS ld FROM lineitem)))""".replace("AS ld FROM (", "AS l_quantity__multiply__l_discount FROM ("))
def _(spark, folder):
    f = table(spark, folder, "lineitem").select("l_quantity", "l_discount")
    return rounded(features.transform_features(f, True, True, True, True)).drop("row_std", "row_median")


_FRAME = "OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("rolling_features", f"""
  SELECT event_id, value, {sql_rnd(f'avg(value) {_FRAME}')} AS value__rmean, {sql_rnd(f'coalesce(stddev_samp(value) {_FRAME}, 0.0)')} AS value__rstd,
         min(value) {_FRAME} AS value__rmin, max(value) {_FRAME} AS value__rmax FROM events""")
def _(spark, folder):
    return rounded(features.rolling_features(table(spark, folder, "events").select("event_id", "value"), ["event_id"], ["value"]))


_FRAME_BY = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("rolling_features_per_entity", f"""
  SELECT event_id, user_id, {sql_rnd(f'avg(value) {_FRAME_BY}')} AS value__rmean, {sql_rnd(f'coalesce(stddev_samp(value) {_FRAME_BY}, 0.0)')} AS value__rstd,
         min(value) {_FRAME_BY} AS value__rmin, max(value) {_FRAME_BY} AS value__rmax FROM events""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return rounded(features.rolling_features(e, ["ts", "event_id"], ["value"], 3, ["user_id"])).drop("ts", "value")


@query("group_features", f"""
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, {sql_rnd('g.m', 6)} AS o_totalprice__mean__o_custkey, {sql_rnd('g.s', 6)} AS o_totalprice__std__o_custkey
  FROM orders o LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY o_custkey) g USING (o_custkey)""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(features.group_features(o, ["o_custkey"], ["o_totalprice"]), 6)


# --- selection ------------------------------------------------------------------------------------------------------

@query("selected_by_variance", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_rnd(f'var_samp({c})', 5)} AS variance FROM lineitem" for c in NUMERIC) + ") WHERE variance > 0.0008")
def _(spark, folder):
    return rounded(select.by_variance(flows(spark, folder), 0.0008), 5)


@query("selected_by_target", f"WITH d AS ({_RELATED}) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_rnd(f'abs(corr({c}, net))')} AS r FROM d" for c in NUMERIC) + ") WHERE r > 0.01")
def _(spark, folder):
    return rounded(select.by_correlation(_related(spark, folder), "net", 0.01, _N))


@query("selected_by_correlation", f"""
  WITH d AS ({_RELATED}), p AS ({_corr(_UPPER)}), s AS (SELECT a AS c, abs(r) AS r FROM p UNION ALL SELECT b, abs(r) FROM p)
  SELECT c AS "column", {sql_rnd('max(r)')} AS r FROM s GROUP BY c HAVING max(r) > 0.05""")
def _(spark, folder):
    return rounded(select.by_correlation(_related(spark, folder), None, 0.05))


@query("redundant_dropped", f"WITH d AS ({_RELATED}) SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM d")
def _(spark, folder):
    return select.drop_redundant(_related(spark, folder), 0.95)


_MI_EDGES = ", ".join(str(i / 16) for i in range(1, 16))


@query("mutual_information", f"""
  WITH v AS (SELECT event_type AS label, 'value' AS c, value::DOUBLE AS x FROM events UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE FROM events
             UNION ALL SELECT event_type, 'shifted', value + CASE WHEN event_type = 'view' THEN 50 ELSE 0 END FROM events),
       e AS (SELECT c, quantile_cont(x, [{_MI_EDGES}]) AS q FROM v GROUP BY c),
       b AS (SELECT c, label, len([t for t in q if x > t]) AS bin FROM v JOIN e USING (c)),
       n AS (SELECT c, bin, label, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
       j AS (SELECT *, sum(n) OVER (PARTITION BY c) AS t, sum(n) OVER (PARTITION BY c, bin) AS nb, sum(n) OVER (PARTITION BY c, label) AS nl FROM n)
  SELECT c AS "column", {sql_rnd('sum(n / t * ln(n * t / (nb * nl)))')} AS mi FROM j GROUP BY c""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_type", "value", "user_id", (
        col("value") + F.when(col("event_type") == "view", 50).otherwise(0)).alias("shifted"))
    return rounded(select.mutual_information(e, "event_type"))


@query("selected_features", f"SELECT l_quantity, l_extendedprice FROM lineitem")
def _(spark, folder):
    d = _related(spark, folder)
    names = select.select_features(d, n=2)
    return d.select(*sorted(names, reverse=True))


@query("target_correlation", f"""WITH d AS (SELECT *, 1.0 AS constant FROM ({_RELATED})), c AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(corr({c}, net), 0.0) AS correlation FROM d" for c in NUMERIC) + f""" UNION ALL SELECT 'constant', 0.0)
  SELECT feature, {sql_rnd('correlation')} AS correlation, {sql_rnd('abs(correlation)')} AS abs_correlation,
         CAST(row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS INTEGER) AS rank FROM c""")
def _(spark, folder):
    d = _related(spark, folder).withColumn("constant", F.lit(1.0))
    return rounded(select.target_correlation(d, "net", [*_N, "constant"]))


# Importance of the 64 embedding dimensions: their share of the total variance.
_IMPORTANCE = """
  WITH d AS (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
       v AS (SELECT 'dim_' || i AS feature, var_samp(x::DOUBLE) AS s FROM d GROUP BY i),
       imp AS (SELECT feature, round(s / (SELECT sum(s) FROM v), 9) AS importance FROM v)"""


def _importance(spark, folder):
    d = table(spark, folder, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    v = d.groupBy("i").agg(F.var_samp(col("x").cast("double")).alias("s"))
    total = v.agg(F.sum("s").alias("t"))
    return v.select(F.concat(F.lit("dim_"), col("i").cast("string")).alias("feature"),
                    F.round(col("s") / total.scalar(), 9).alias("importance"))


_RANKED = "SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp"


@query("importance_ranked", f"{_IMPORTANCE} {_RANKED}")
def _(spark, folder):
    return select.ranked(_importance(spark, folder))


@query("importance_top_k", f"{_IMPORTANCE} SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 7")
def _(spark, folder):
    return select.top_k(_importance(spark, folder), 7)


@query("importance_table", f"""{_IMPORTANCE}, r AS ({_RANKED})
  SELECT rank, feature, round(importance, 4) AS importance, round(importance / (SELECT max(importance) FROM r), 2) AS bar FROM r WHERE rank <= 10""")
def _(spark, folder):
    return select.importance_table(_importance(spark, folder))


@query("importance_threshold", f"{_IMPORTANCE}, r AS ({_RANKED}) SELECT * FROM r WHERE rank <= 5 OR importance >= 0.0157")
def _(spark, folder):
    return select.important(_importance(spark, folder), 0.0157)


@query("importance_redundancy", f"""{_IMPORTANCE}, r AS ({_RANKED})
  SELECT count(*) AS total_features, count(*) FILTER (importance >= 0.0157) AS important_features, count(*) FILTER (importance < 0.0157) AS low_importance_features,
         {sql_rnd('sum(importance) FILTER (rank <= 10)')} AS cumulative_importance_top_10, {sql_rnd('sum(importance) FILTER (rank <= 20)')} AS cumulative_importance_top_20 FROM r""")
def _(spark, folder):
    return rounded(select.redundancy_summary(_importance(spark, folder), 0.0157))


@query("importance_percentile", f"{_IMPORTANCE}, r AS ({_RANKED}) SELECT * FROM r WHERE importance >= (SELECT quantile_cont(importance, 0.75) FROM imp)")
def _(spark, folder):
    return select.suggested(_importance(spark, folder))


_SPREAD_OUT = "event_type AS c, value * 7 + event_id * 0.00001 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) + event_id * 0.00001 AS y"


@query("neighbour_information", f"""
  WITH l AS MATERIALIZED (SELECT event_id, c, unnest(['x', 'y']) AS f, unnest([x, y]) AS v FROM (SELECT event_id, {_SPREAD_OUT} FROM events) e),
  n AS (SELECT f, c, count(*) AS n FROM l GROUP BY ALL),
  r AS MATERIALIZED (SELECT f, event_id, c, v, d FROM (
         SELECT a.f, a.event_id, a.c, a.v, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.f, a.event_id ORDER BY abs(a.v - b.v)) AS nth
         FROM l a JOIN l b ON a.f = b.f AND a.c = b.c AND a.event_id <> b.event_id) x WHERE nth = 3),
  m AS (SELECT r.f, r.event_id, r.c, count(*) AS m FROM r JOIN l b ON r.f = b.f AND b.v > r.v - r.d * 1.001 AND b.v < r.v + r.d * 1.001 WHERE abs(b.v - r.v) < r.d GROUP BY ALL),
  h AS MATERIALIZED (SELECT i, -0.5772156649015329 + coalesce(sum(1.0 / (i - 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS psi
        FROM (SELECT unnest(range(2, (SELECT count(*) + 2 FROM events))) AS i) k),
  p AS (SELECT i, psi FROM h UNION ALL SELECT 1, -0.5772156649015329)
  SELECT m.f AS "column", {sql_rnd('greatest(0.0, (SELECT psi FROM p WHERE i = (SELECT count(*) FROM events)) + (SELECT psi FROM p WHERE i = 3) - avg(pn.psi) - avg(pm.psi))')} AS mi
  FROM m JOIN n ON m.f = n.f AND m.c = n.c JOIN p pn ON pn.i = n.n JOIN p pm ON pm.i = m.m GROUP BY m.f""")
def _(spark, folder):
    """Two features whose values all differ, and the class of an event."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, folder, "events").select("event_id", col("event_type").alias("c"), (col("value") * 7 + col("event_id") * 0.00001).alias("x"),
                                              (k + col("event_id") * 0.00001).alias("y"))
    return rounded(neighbours.neighbour_information(e, "c", ["event_id"], ["x", "y"]))
