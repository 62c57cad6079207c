"""Queries over scans, cleaning, preparation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import col, work_path
from ..operators import clean, prepare
from ..sources import scans
from .inputs import DIRTY, FLOWS, NUMERIC, dirty, flows, table
from .registry import query, rnd, rounded, sql_rnd

_LABEL_SQL = "CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'A' THEN 'DoS Hulk' ELSE 'Other' END"


def _raw_csv(spark, folder):
    """Lineitem as a raw flow file: headers with a leading blank, labels with blanks around them."""
    path = work_path(spark, "raw-flows")
    label = F.expr(_LABEL_SQL.replace("'BENIGN'", "'BENIGN  '"))
    raw = table(spark, folder, "lineitem").select(
        *[col(c).alias(f" {c}") for c in NUMERIC], F.concat(F.lit(" "), label).alias(" Label"))
    scans.write_csv(raw, path)
    return path


_RAW_SCHEMA = "` l_quantity` double, ` l_extendedprice` double, ` l_discount` double, ` l_tax` double, ` Label` string"


@query("scan_csv", f"SELECT l_quantity AS \" l_quantity\", l_extendedprice AS \" l_extendedprice\", l_discount AS \" l_discount\", l_tax AS \" l_tax\", trim({_LABEL_SQL}) AS label FROM lineitem")
def _(spark, folder):
    # White space around values is kept by the reader and cut here.
    return scans.load_raw_flows(spark, _raw_csv(spark, folder), _RAW_SCHEMA) \
        .select(*[col(f" {c}") for c in NUMERIC], F.trim(col(" Label")).alias("label"))


@query("scan_clean_flows", f"SELECT l_quantity, l_extendedprice, l_discount, l_tax, {_LABEL_SQL} AS \"Label\" FROM lineitem WHERE l_returnflag <> 'R'")
def _(spark, folder):
    return scans.load_clean_flows(spark, _raw_csv(spark, folder), schema=_RAW_SCHEMA)


@query("scan_many_folders", """
  SELECT l_returnflag, count(*) AS n, count(l_tax) AS with_tax, round(sum(l_quantity), 4) AS quantity FROM (
    SELECT l_returnflag, l_quantity, l_tax FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT l_returnflag, l_quantity, NULL FROM lineitem WHERE l_linestatus = 'O') u GROUP BY l_returnflag""")
def _(spark, folder):
    old, new = work_path(spark, "old"), work_path(spark, "new")
    li = table(spark, folder, "lineitem")
    scans.write_csv(li.filter("l_linestatus = 'F'").select("l_returnflag", "l_quantity", "l_tax"), old)
    scans.write_csv(li.filter("l_linestatus = 'O'").select("l_quantity", "l_returnflag"), new)
    both = scans.read_folders(spark, [old, new], ["l_returnflag string, l_quantity double, l_tax double",
                                                  "l_quantity double, l_returnflag string"])
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("with_tax"),
                                            rnd(F.sum("l_quantity"), 4).alias("quantity"))


@query("concat_by_name", """
  SELECT 'o' AS kind, o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders
  UNION ALL SELECT 'c', c_custkey, c_acctbal, NULL, c_mktsegment FROM customer""")
def _(spark, folder):
    o = table(spark, folder, "orders").select(F.lit("o").alias("kind"), col("o_orderkey").alias("id"),
                                              col("o_totalprice").alias("amount"), col("o_orderstatus").alias("status"))
    c = table(spark, folder, "customer").select(F.lit("c").alias("kind"), col("c_custkey").alias("id"),
                                                col("c_mktsegment").alias("segment"), col("c_acctbal").alias("amount"))
    return scans.concat([o, c])


@query("label_set_difference", """
  SELECT 'unexpected' AS side, label FROM (SELECT DISTINCT event_type AS label FROM events
    EXCEPT SELECT unnest(['view', 'click', 'login']))
  UNION ALL SELECT 'absent', label FROM (SELECT unnest(['view', 'click', 'login']) AS label EXCEPT SELECT event_type FROM events)
  UNION ALL SELECT 'shared', label FROM (SELECT unnest(['view', 'click', 'login']) AS label INTERSECT SELECT event_type FROM events)""")
def _(spark, folder):
    from ..operators.validate import label_sets
    return label_sets(table(spark, folder, "events"), "event_type", ["view", "click", "login"])


@query("trimmed_names_and_labels", "SELECT l_quantity, trim('  ' || l_returnflag || ' ') AS flag FROM lineitem")
def _(spark, folder):
    raw = flows(spark, folder).select(col("l_quantity").alias(" l_quantity "),
                                      F.concat(F.lit("  "), col("l_returnflag"), F.lit(" ")).alias(" flag"))
    return scans.trim_labels(scans.strip_column_names(raw), " flag")


@query("known_labels", f"{FLOWS} WHERE l_returnflag IN ('N', 'A')")
def _(spark, folder):
    return scans.keep_known_labels(flows(spark, folder), "l_returnflag", "N", ["A"])


@query("features_and_label", "SELECT e.event_id, e.value, e.user_id, e.event_type FROM events e")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "value", "event_type")
    features, label = scans.split_features_and_label(e, "event_type", ["event_id"])
    return features.join(label, "event_id")


@query("benign_rows", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE trim(l_returnflag) = 'N'")
def _(spark, folder):
    return scans.benign_only(flows(spark, folder), "l_returnflag", "N")


@query("configured_features", "SELECT l_tax, l_quantity FROM lineitem")
def _(spark, folder):
    return scans.select_configured(flows(spark, folder), ["l_tax", "Flow Duration", "l_quantity"])


@query("aligned_columns", "SELECT l_quantity, l_tax, 0.0::DOUBLE AS score FROM lineitem")
def _(spark, folder):
    train = spark.createDataFrame([], "score double, l_tax double, l_quantity double")
    return clean.align_to(train, flows(spark, folder))[1]


@query("column_difference", """
  SELECT d.side, d."column", CASE WHEN d.side = 'only_in_b' THEN NULL ELSE (SELECT count(*) FROM lineitem) END AS rows FROM
    (VALUES ('only_in_a', 'l_discount'), ('only_in_a', 'l_extendedprice'), ('only_in_a', 'l_tax'), ('only_in_b', 'l_orderkey'),
            ('only_in_b', 'l_partkey'), ('common', 'l_quantity'), ('common', 'l_returnflag')) d(side, "column")""")
def _(spark, folder):
    a = flows(spark, folder)
    b = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    filled = clean.missing_counts(a).select("column", "rows")
    return clean.column_difference(a, b).join(filled, "column", "left").select("side", "column", "rows")


@query("coerced_features", "SELECT coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS event_type, value, CAST(user_id AS DOUBLE) AS user_id FROM events")
def _(spark, folder):
    return clean.coerced_features(table(spark, folder, "events"), ["event_id", "ts", "props"])


@query("binary_label", "SELECT event_id, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS y FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", clean.binary_label(col("event_type"), "view").alias("y"))


@query("label_codes", """
  SELECT e.event_id, e.event_type, CAST(c.code AS INTEGER) AS code, e.event_type AS decoded FROM events e JOIN
    (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) c
    USING (event_type)""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type")
    model = prepare.fit_label_indexer(e, "event_type", "code")
    return prepare.decode_labels(prepare.encode_labels(e, "event_type", "code", model), "code", "decoded", model)


@query("label_encoder_saved_and_loaded", """
  WITH c AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0))
  SELECT e.event_id, c.code, e.event_type AS decoded FROM events e JOIN c USING (event_type)""")
def _(spark, folder):
    """Fitted on every other event, saved, loaded, and applied to all."""
    e, path = table(spark, folder, "events").select("event_id", "event_type"), work_path(spark, "encoder")
    prepare.save_label_indexer(prepare.fit_label_indexer(e.filter("event_id % 2 = 0"), "event_type", "code"), path)
    again = prepare.load_label_indexer(path)
    coded = prepare.encode_labels(e, "event_type", "code", again).drop("event_type")
    return prepare.decode_labels(coded, "code", "decoded", again)


@query("label_mapping", """
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT event_type AS label FROM events)""")
def _(spark, folder):
    return prepare.label_codes(table(spark, folder, "events"), "event_type").withColumn("code", col("code").cast("bigint"))


@query("distinct_wide_rows", "SELECT DISTINCT * FROM (SELECT lineitem.* FROM lineitem, (SELECT unnest(range(3)) AS copy) c WHERE copy = 0 OR l_linenumber = copy) x")
def _(spark, folder):
    """Whole lines, some of them two or three times."""
    lines = table(spark, folder, "lineitem")
    return clean.drop_duplicates_wide(lines.unionByName(lines.filter("l_linenumber = 1")).unionByName(lines.filter("l_linenumber = 2")))


@query("distinct_rows", f"SELECT DISTINCT * FROM ({DIRTY})")
def _(spark, folder):
    return clean.drop_duplicates(dirty(spark, folder))


@query("duplicate_count", f"""
  SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates
  FROM (SELECT count(*) AS n FROM ({DIRTY}) d GROUP BY ALL)""".replace("SELECT count(*) AS n FROM", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, count(*) AS n FROM"))
def _(spark, folder):
    return clean.duplicate_count(dirty(spark, folder))


@query("missing_dropped", f"SELECT * FROM ({DIRTY}) WHERE l_tax IS NOT NULL")
def _(spark, folder):
    return clean.handle_missing(dirty(spark, folder), "drop")


@query("missing_filled", f"SELECT * REPLACE (coalesce(l_tax, -1.0) AS l_tax) FROM ({DIRTY})")
def _(spark, folder):
    return clean.handle_missing(dirty(spark, folder), "fill", fill_value=-1.0)


@query("missing_columns_dropped", "SELECT l_quantity, l_tax FROM (SELECT l_quantity, NULLIF(l_tax, 0.0) AS l_tax FROM lineitem) WHERE l_tax IS NOT NULL")
def _(spark, folder):
    one = table(spark, folder, "lineitem").select(
        "l_quantity", F.nullif(col("l_tax"), F.lit(0.0)).alias("l_tax"),
        F.when(col("l_linenumber") == 1, col("l_discount")).alias("l_discount"))
    return clean.handle_missing(one, "drop_columns")


@query("infinite_replaced", f"SELECT * REPLACE (CASE WHEN isinf(l_extendedprice) THEN -1.0 ELSE l_extendedprice END AS l_extendedprice) FROM ({DIRTY})")
def _(spark, folder):
    return clean.replace_infinite(dirty(spark, folder), -1.0)


@query("infinite_counts", f"SELECT 'l_extendedprice' AS \"column\", count(*) AS infinite FROM ({DIRTY}) WHERE isinf(l_extendedprice)")
def _(spark, folder):
    return clean.infinite_counts(dirty(spark, folder))


_CLIP = ", ".join(f"quantile_cont({c}, 0.05) AS {c}_lo, quantile_cont({c}, 0.95) AS {c}_hi" for c in NUMERIC)


@query("outliers_clipped", f"""
  SELECT {', '.join(sql_rnd(f'greatest(least({c}, {c}_hi), {c}_lo)') + f' AS {c}' for c in NUMERIC)}
  FROM lineitem, (SELECT {_CLIP} FROM lineitem) q""")
def _(spark, folder):
    return rounded(clean.clip_outliers(table(spark, folder, "lineitem").select(*NUMERIC), 90.0))


@query("outlier_bounds", " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", {sql_rnd('lo')} AS lower, {sql_rnd('hi')} AS upper, n AS clipped FROM (
    SELECT any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER ({c} < lo OR {c} > hi) AS n FROM lineitem,
    (SELECT quantile_cont({c}, 0.005) AS lo, quantile_cont({c}, 0.995) AS hi FROM lineitem) q) WHERE n > 0""" for c in NUMERIC))
def _(spark, folder):
    return rounded(clean.clip_bounds(table(spark, folder, "lineitem").select(*NUMERIC), 99.0))


@query("cleaned", f"""
  SELECT * REPLACE (CASE WHEN isinf(l_extendedprice) THEN 0.0 ELSE l_extendedprice END AS l_extendedprice)
  FROM (SELECT DISTINCT * FROM ({DIRTY})) WHERE l_tax IS NOT NULL""")
def _(spark, folder):
    return clean.clean(dirty(spark, folder))


@query("cleaning_report", f"""
  WITH d AS ({DIRTY}), u AS (SELECT DISTINCT * FROM d)
  SELECT (SELECT count(*) FROM d) AS original_rows, (SELECT count(*) FROM d) - count(*) AS duplicates_dropped,
         CAST(max(CASE WHEN isinf(l_extendedprice) THEN 1 ELSE 0 END) AS BIGINT) AS infinite_columns,
         count(*) - count(l_tax) AS nulls_before, count(l_tax) AS rows_after,
         (SELECT count(*) FROM d) - count(l_tax) AS rows_dropped FROM u""")
def _(spark, folder):
    return clean.cleaning_report(dirty(spark, folder))


@query("missing_summary", f"SELECT 'l_tax' AS \"column\", count(*) AS missing, (SELECT count(*) FROM ({DIRTY})) AS rows FROM ({DIRTY}) WHERE l_tax IS NULL")
def _(spark, folder):
    return clean.missing_summary(dirty(spark, folder))


def _imputed_sql(fill):
    return f"""WITH d AS (SELECT l_quantity, NULLIF(l_tax, 0.0) AS l_tax FROM lineitem)
      SELECT l_quantity, {sql_rnd(f"coalesce(l_tax, (SELECT {fill} FROM d))", 9)} AS l_tax FROM d"""


def _sparse_tax(spark, folder):
    return table(spark, folder, "lineitem").select("l_quantity", F.nullif(col("l_tax"), F.lit(0.0)).alias("l_tax"))


for _strategy, _fill in {"mean": "avg(l_tax)", "median": "quantile_cont(l_tax, 0.5)", "constant": "any_value(0.5)"}.items():
    @query(f"imputed_{_strategy}", _imputed_sql(_fill))
    def _(spark, folder, strategy=_strategy):
        return rounded(prepare.impute(_sparse_tax(spark, folder), strategy, fill_value=0.5), 9)


@query("imputed_most_frequent", """
  WITH d AS (SELECT l_quantity, NULLIF(l_tax, 0.0) AS l_tax FROM lineitem),
       m AS (SELECT l_tax AS v FROM d WHERE l_tax IS NOT NULL GROUP BY l_tax ORDER BY count(*) DESC, l_tax LIMIT 1)
  SELECT l_quantity, coalesce(l_tax, (SELECT v FROM m)) AS l_tax FROM d""")
def _(spark, folder):
    return prepare.impute(_sparse_tax(spark, folder), "most_frequent")


@query("imputer_fitted_elsewhere", f"""
  SELECT o_orderkey, {sql_rnd("coalesce(NULLIF(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END, 0.0), (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F'))", 4)} AS o_totalprice
  FROM orders WHERE o_orderstatus <> 'F'""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    fitted = prepare.fit_imputer(orders.filter("o_orderstatus = 'F'"), ["o_totalprice"], "mean")
    gaps = orders.filter("o_orderstatus <> 'F'").select(
        "o_orderkey", F.when(col("o_orderkey") % 4 != 0, col("o_totalprice")).alias("o_totalprice"))
    return rounded(prepare.apply_imputer(gaps, fitted), 4)


def _scaled_sql(center, spread):
    cells = ", ".join(f"{sql_rnd(f'({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END')} AS {c}" for c in NUMERIC)
    fit = ", ".join(f"{center.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in NUMERIC)
    return f"SELECT {cells} FROM lineitem, (SELECT {fit} FROM lineitem) f"


for _method, _parts in {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}.items():
    @query(f"scaled_{_method}", _scaled_sql(*_parts))
    def _(spark, folder, method=_method):
        features = table(spark, folder, "lineitem").select(*NUMERIC)
        return rounded(prepare.scale(features, prepare.fit_scaler(features, NUMERIC, method)))


@query("scaler_saved_and_loaded", _scaled_sql("avg({c})", "stddev_pop({c})"))
def _(spark, folder):
    features, path = table(spark, folder, "lineitem").select(*NUMERIC), work_path(spark, "scaler")
    prepare.save_fitted(prepare.fit_scaler(features, NUMERIC), path)
    return rounded(prepare.scale(features, prepare.load_fitted(spark, path)))


@query("scaling_undone", f"SELECT {', '.join(sql_rnd(c) + f' AS {c}' for c in NUMERIC)} FROM lineitem")
def _(spark, folder):
    features = table(spark, folder, "lineitem").select(*NUMERIC)
    fitted = prepare.fit_scaler(features, NUMERIC)
    return rounded(prepare.unscale(prepare.scale(features, fitted), fitted))


@query("minimal_clean", f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM ({DIRTY}) WHERE l_tax IS NOT NULL AND NOT isinf(l_extendedprice)")
def _(spark, folder):
    return clean.minimal_clean(dirty(spark, folder).withColumn("empty", F.lit(None).cast("double")))


@query("exploration_clean", """
  WITH d AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS l_extendedprice,
                    NULLIF(l_tax, 0.0) AS l_tax, CASE WHEN l_returnflag = 'R' THEN '  ' ELSE l_returnflag END AS "Label" FROM lineitem),
       b AS (SELECT * REPLACE (CASE WHEN "Label" SIMILAR TO '\\s*' THEN NULL ELSE "Label" END AS "Label") FROM d),
       k AS (SELECT * FROM b WHERE "Label" IS NOT NULL),
       t AS (SELECT * REPLACE (coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM k)) AS l_tax) FROM k),
       i AS (SELECT * REPLACE (CASE WHEN isinf(l_extendedprice) THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM t)
  SELECT * REPLACE (round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM i)), 6) AS l_extendedprice) FROM i""")
def _(spark, folder):
    d = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(col("l_extendedprice")).alias("l_extendedprice"),
        F.nullif(col("l_tax"), F.lit(0.0)).alias("l_tax"),
        F.when(col("l_returnflag") == "R", "  ").otherwise(col("l_returnflag")).alias("Label"))
    return rounded(clean.exploration_clean(d))


@query("random_sample", """
  SELECT event_id, user_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 500""")
def _(spark, folder):
    return clean.sample_rows(table(spark, folder, "events").select("event_id", "user_id", "value"), ["event_id"], 500, 42)


_SPLIT = """
  WITH d AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42')) AS rn,
                    count(*) OVER (PARTITION BY event_type) AS n FROM events),
       s AS (SELECT *, ceil(round(n * 0.2, 9)) AS nt, ceil(round((n - ceil(round(n * 0.2, 9))) * (0.1 / (1 - 0.2)), 9)) AS nv FROM d),
       split AS (SELECT event_id, event_type, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split FROM s)"""


def _split(spark, folder):
    return prepare.add_split(table(spark, folder, "events").select("event_id", "event_type"), ["event_id"], "event_type")


@query("stratified_split", f"{_SPLIT} SELECT * FROM split")
def _(spark, folder):
    return _split(spark, folder)


@query("split_sizes", f"""{_SPLIT}
  SELECT split, n, round(n / total, 6) AS share, expected, coalesce(abs(n / total - expected) <= 0.02, TRUE) AS ok FROM (
    SELECT split, count(*) AS n, CAST(CASE split WHEN 'test' THEN 0.2 WHEN 'val' THEN 0.1 END AS DOUBLE) AS expected,
           (SELECT count(*) FROM split)::DOUBLE AS total FROM split GROUP BY split)""")
def _(spark, folder):
    return rounded(prepare.split_sizes(_split(spark, folder)))


@query("split_class_shares", f"""{_SPLIT}, c AS (SELECT event_type AS label, split, count(*)::DOUBLE AS n FROM split GROUP BY ALL),
    t AS (SELECT split, sum(n) AS total FROM c GROUP BY split),
    p AS (SELECT label, sum(CASE WHEN c.split = 'train' THEN n / total ELSE 0 END) AS tr, sum(CASE WHEN c.split = 'val' THEN n / total ELSE 0 END) AS va,
                 sum(CASE WHEN c.split = 'test' THEN n / total ELSE 0 END) AS te FROM c JOIN t ON c.split = t.split GROUP BY label)
  SELECT label, round(tr, 6) AS train_share, round(va, 6) AS val_share, round(te, 6) AS test_share, abs(va - tr) <= 0.05 AND abs(te - tr) <= 0.05 AS ok FROM p""")
def _(spark, folder):
    return rounded(prepare.split_class_shares(_split(spark, folder), "event_type"))


@query("split_table_pruned", f"{_SPLIT} SELECT event_id, event_type FROM split WHERE split = 'val'")
def _(spark, folder):
    path = work_path(spark, "splits")
    scans.write_splits(_split(spark, folder), path)
    return scans.read_split(spark, path, "val")
