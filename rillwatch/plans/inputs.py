"""The given tables in the roles the operators expect, each as a frame and as the SQL text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import col

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that comes in fewer partitions than there are cores, before work that is heavy per row.

    The given tables are single files; a table of many splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Labelled flows: lineitem, 'N' in the role of the benign label.
FLOWS = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem"


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(*NUMERIC, "l_returnflag")


# Flows with defects put in by rule: missing tax, infinite price, copies of the first line of each order.
DIRTY = """
  SELECT l_orderkey, l_linenumber, l_quantity,
         CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS l_extendedprice,
         l_discount, NULLIF(l_tax, 0.0) AS l_tax, l_returnflag
  FROM lineitem, (SELECT unnest([1, 2]) AS copy) c WHERE copy = 1 OR l_linenumber = 1"""


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    flawed = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"), "l_returnflag")
    return flawed.unionByName(flawed.filter("l_linenumber = 1"))


# The class of an event, as a label of the flow table.
CLASS_SQL = """CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'DoS Hulk' WHEN 'purchase' THEN 'DoS GoldenEye'
    WHEN 'signup' THEN 'DoS Slowloris' ELSE 'Heartbleed' END"""


def event_class():
    return F.expr(CLASS_SQL)


# Detections: events scored by value; k of the JSON column stands for the confidence in percent.
DETECTIONS = f"""
  SELECT *, is_anomaly AND (raw_class = 'BENIGN' OR classification_confidence < 0.5) AS is_zero_day,
         CASE WHEN NOT is_anomaly THEN 'BENIGN'
              WHEN raw_class = 'BENIGN' OR classification_confidence < 0.5 THEN 'ZERO_DAY' ELSE raw_class END AS predicted_class,
         CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high'
              WHEN anomaly_score >= 0.5 THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT event_id, ts, 'user_' || user_id AS sample_id, least(value / 150.0, 1.0) AS anomaly_score,
               value / 150.0 > 0.3 AS is_anomaly, {CLASS_SQL} AS raw_class,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS classification_confidence,
               event_id // 100 AS batch_id, (event_id % 97) * 0.5::DOUBLE AS detection_latency_ms
        FROM events) e"""


def detections(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return from_events(events)


def from_events(events: DataFrame) -> DataFrame:
    scored = events.select(
        "event_id", "ts", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("sample_id"),
        F.least(F.col("value") / 150.0, F.lit(1.0)).alias("anomaly_score"),
        (F.col("value") / 150.0 > 0.3).alias("is_anomaly"), event_class().alias("raw_class"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("classification_confidence"),
        F.expr("event_id div 100").alias("batch_id"),
        (F.col("event_id") % 97 * 0.5).alias("detection_latency_ms"))
    odd = (F.col("raw_class") == "BENIGN") | (F.col("classification_confidence") < 0.5)
    return scored.select(
        "*", (F.col("is_anomaly") & odd).alias("is_zero_day"),
        F.when(~F.col("is_anomaly"), "BENIGN").when(odd, "ZERO_DAY").otherwise(F.col("raw_class")).alias("predicted_class"),
        F.when(F.col("anomaly_score") >= 0.9, "critical").when(F.col("anomaly_score") >= 0.7, "high")
        .when(F.col("anomaly_score") >= 0.5, "medium").otherwise("low").alias("severity"))


# Truth and prediction per event: one prediction in five is another class; score leans towards the attacks.
JUDGED = f"""
  SELECT event_id, y_true, CASE WHEN k % 5 > 0 THEN y_true ELSE other END AS y_pred,
         CASE WHEN y_true = 'BENIGN' THEN 0 ELSE 1 END AS y, k / 100.0 AS confidence,
         least((value + CASE WHEN y_true = 'BENIGN' THEN 0 ELSE 30 END) / 200.0, 1.0) AS score
  FROM (SELECT event_id, value, {CLASS_SQL} AS y_true, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CASE event_id % 3 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS Hulk' ELSE 'Heartbleed' END AS other
        FROM events) e"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    other = F.expr("CASE event_id % 3 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS Hulk' ELSE 'Heartbleed' END")
    e = table(spark, folder, "events").select(
        "event_id", "value", event_class().alias("y_true"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        other.alias("other"))
    benign = F.col("y_true") == "BENIGN"
    return e.select("event_id", "y_true",
                    F.when(F.col("k") % 5 > 0, F.col("y_true")).otherwise(F.col("other")).alias("y_pred"),
                    F.when(benign, 0).otherwise(1).alias("y"), (F.col("k") / 100.0).alias("confidence"),
                    F.least((F.col("value") + F.when(benign, 0).otherwise(30)) / 200.0, F.lit(1.0)).alias("score"))


# Operation log: one row per event.
OPERATIONS = """
  SELECT event_id, event_type AS operation, event_id // 100 AS batch_id, 'handler_' || (event_id % 3) AS handler,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0 AS success, 1 + event_id % 50 AS samples,
         value / 1000.0 AS elapsed_s, value AS duration_ms FROM events"""


def operations(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", col("event_type").alias("operation"), F.expr("event_id div 100").alias("batch_id"),
                    F.concat(F.lit("handler_"), (F.col("event_id") % 3).cast("string")).alias("handler"),
                    (F.get_json_object("props", "$.k").cast("int") % 10 != 0).alias("success"),
                    (F.lit(1) + F.col("event_id") % 50).alias("samples"), (F.col("value") / 1000.0).alias("elapsed_s"),
                    F.col("value").alias("duration_ms"))
