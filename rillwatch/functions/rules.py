"""Row rules over scored flows: severity, decision, alert text, response actions. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (BENIGN, MIN_CONFIDENCE, SEVERITY_ICONS, SEVERITY_MIN_SCORE, SEVERITY_RANKED, UNKNOWN, UNKNOWN_ICON,
                         ZERO_DAY, ZERO_DAY_BOOST, ZERO_DAY_CONFIDENCE)
from ..core import chain, col


# --- scores and severities ------------------------------------------------------------------------------------------

def sigmoid_score(decision: Column) -> Column:
    """Decision value to (0, 1), larger for more anomalous; the exponent is kept within +-500."""
    return 1.0 / (1.0 + F.exp(F.least(F.greatest(decision, F.lit(-500.0)), F.lit(500.0))))


def _level(score: Column) -> Column:
    top = {k: v for k, v in SEVERITY_MIN_SCORE.items() if k != "low"}
    return chain([(score >= v, k) for k, v in top.items()], "low")


def severity_plain(score: Column, confidence: Column, zero_day: Column) -> Column:
    """By score without boost; a confident zero-day is critical."""
    return chain([(score >= SEVERITY_MIN_SCORE["critical"], "critical"),
                  (zero_day & (confidence >= ZERO_DAY_CONFIDENCE), "critical")], _level(score))


def severity_boosted(score: Column, zero_day: Column, boost: float = ZERO_DAY_BOOST) -> Column:
    """By score, a zero-day with its score raised by the boost (at most 1). The default rule."""
    return _level(F.when(zero_day, F.round(F.least(F.lit(1.0), score + boost), 10)).otherwise(score))


def severity_configured(score: Column, levels: dict[str, float] = SEVERITY_MIN_SCORE) -> Column:
    """First configured level whose lowest score is reached, else low."""
    ordered = sorted(levels.items(), key=lambda kv: -kv[1])
    return chain([(score >= v, k) for k, v in ordered], "low")


def severity_raised(severity: Column, zero_day: Column) -> Column:
    """One level up for a zero-day; an unknown level of a zero-day counts as the lowest."""
    up = [(severity == a, b) for a, b in zip(SEVERITY_RANKED, SEVERITY_RANKED[1:])]
    top = SEVERITY_RANKED[-1]
    return F.when(zero_day, chain([*up, (severity == top, top)], SEVERITY_RANKED[1])).otherwise(severity)


def threshold_confidence(score: Column, threshold: Column | float) -> Column:
    """Relative distance to the threshold, at most 1; 0 for a threshold of 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(t > 0, F.least(F.try_divide(F.abs(score - t), t), F.lit(1.0))).otherwise(0.0)


def threat_level(rate_percent: Column) -> Column:
    return chain([(rate_percent > 10, "critical"), (rate_percent > 5, "high"), (rate_percent > 1, "medium")], "low")


# --- decision -------------------------------------------------------------------------------------------------------

def decision(anomalous: Column, label: Column, confidence: Column, probabilities: Column | None = None,
             benign: str = BENIGN, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """Struct (predicted_class, confidence, probabilities, is_zero_day, reason) of the two-stage rule."""
    none = F.create_map().cast("map<string,double>")
    given = F.coalesce(probabilities, none) if probabilities is not None else none

    def outcome(name: Column | str, conf: Column, probs: Column, zero_day: bool, reason: str) -> Column:
        return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("predicted_class"),
                        conf.cast("double").alias("confidence"), probs.alias("probabilities"),
                        F.lit(zero_day).alias("is_zero_day"), F.lit(reason).alias("reason"))

    return (F.when(~F.coalesce(anomalous, F.lit(False)),
                   outcome(benign, F.lit(1.0), F.create_map(F.lit(benign), F.lit(1.0)), False, "not_anomalous"))
            .when(label.isNull() | confidence.isNull(), outcome(UNKNOWN, F.lit(0.0), none, True, "anomaly_no_classifier"))
            .when(label == benign, outcome(ZERO_DAY, confidence, given, True, "anomaly_classified_as_benign"))
            .when(confidence < min_confidence, outcome(ZERO_DAY, confidence, given, True, "low_classification_confidence"))
            .otherwise(outcome(label, confidence, given, False, "known_attack")))


# --- alerts ---------------------------------------------------------------------------------------------------------

def alert_message(predicted: Column, score: Column, confidence: Column, zero_day: Column, severity: Column) -> Column:
    four = lambda c: F.format_string("%.4f", c)
    tail = F.concat(F.lit("Severity: "), F.upper(severity))
    return F.when(zero_day, F.concat(
        F.lit("ZERO-DAY THREAT DETECTED: Anomalous traffic (score="), four(score),
        F.lit(") not matching any known attack class. "), tail)).otherwise(F.concat(
            F.lit("DoS ATTACK DETECTED: "), predicted, F.lit(" (anomaly_score="), four(score), F.lit(", confidence="),
            four(confidence), F.lit("). "), tail))


def alert_id(sample_id: Column, score: Column) -> Column:
    """alert_{sample}_{score in ten-thousandths, cut off}."""
    return F.concat(F.lit("alert_"), sample_id, F.lit("_"), (score * 10000).cast("bigint").cast("string"))


def _named(df: DataFrame) -> dict[str, Column]:
    return {c: col(c) for c in df.columns}


def alert_rows(detections: DataFrame) -> DataFrame:
    """One alert per anomalous detection, with the deterministic id."""
    d = detections.filter("is_anomaly")
    c = _named(d)
    return d.select(alert_id(c["sample_id"], c["anomaly_score"]).alias("alert_id"), "sample_id", "severity", "predicted_class",
                    "anomaly_score", "classification_confidence", "is_zero_day",
                    alert_message(c["predicted_class"], c["anomaly_score"], c["classification_confidence"], c["is_zero_day"],
                                  c["severity"]).alias("message"))


def generated_alerts(detections: DataFrame, filter_normal: bool = True, filter_below_confidence: bool = True,
                     min_confidence: float = MIN_CONFIDENCE, timestamp: Column | None = None) -> DataFrame:
    """Alerts with raised severity: no normal rows, no known attacks under the confidence; details as a struct."""
    d = detections
    if filter_normal:
        d = d.filter("is_anomaly")
    if filter_below_confidence:
        d = d.filter(col("is_zero_day") | (col("classification_confidence") >= min_confidence))
    c = _named(d)
    when = timestamp if timestamp is not None else (c["ts"] if "ts" in c else F.current_timestamp())
    seconds = F.unix_timestamp(when.cast("timestamp"))
    ident = F.concat(F.lit("alert_"), F.substring(F.sha2(F.concat_ws("|", c["sample_id"], when.cast("string")), 256), 1, 8),
                     F.lit("_"), seconds.cast("string"))
    threshold = c.get("anomaly_threshold", F.lit(None).cast("double"))
    probabilities = c.get("class_probabilities", F.lit(None).cast("map<string,double>"))
    return d.select(
        ident.alias("alert_id"), "sample_id", when.alias("timestamp"),
        severity_raised(c["severity"], c["is_zero_day"]).alias("severity"), "predicted_class", "anomaly_score",
        "classification_confidence", "is_zero_day",
        alert_message(c["predicted_class"], c["anomaly_score"], c["classification_confidence"], c["is_zero_day"],
                      c["severity"]).alias("message"),
        F.struct(threshold.alias("anomaly_threshold"), probabilities.alias("class_probabilities"),
                 c.get("detection_latency_ms", F.lit(0.0)).alias("detection_latency_ms")).alias("details"))


def normalised_detections(df: DataFrame) -> DataFrame:
    """Fixed fields with defaults; absent columns count as missing values."""
    defaults = {"timestamp": F.lit(None).cast("timestamp_ntz"), "is_anomaly": F.lit(False), "anomaly_score": F.lit(0.0),
                "predicted_class": F.lit(UNKNOWN), "classification_confidence": F.lit(0.0), "is_zero_day": F.lit(False),
                "severity": F.lit("low"), "latency_ms": F.lit(0.0)}
    return df.select(*[(F.coalesce(col(n), d) if n in df.columns else d).alias(n) for n, d in defaults.items()])


def normalised_alerts(df: DataFrame) -> DataFrame:
    return normalised_detections(df).select("timestamp", "severity", "is_zero_day", "predicted_class")


# --- formats --------------------------------------------------------------------------------------------------------

def alert_text(df: DataFrame, at: Column) -> Column:
    """Seven lines per alert."""
    c = _named(df)
    icon = chain([(c["severity"] == k, v) for k, v in SEVERITY_ICONS.items()], UNKNOWN_ICON)
    return F.concat_ws(
        "\n", F.concat(icon, F.lit(" ["), F.upper(c["severity"]), F.lit("] Alert: "), c["alert_id"]),
        F.concat(F.lit("  Time:      "), F.date_format(at, "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("  Class:     "), c["predicted_class"]),
        F.concat(F.lit("  Score:     "), F.format_string("%.4f", c["anomaly_score"])),
        F.concat(F.lit("  Confidence:"), F.format_string("%.4f", c["classification_confidence"])),
        F.concat(F.lit("  Zero-Day:  "), F.when(c["is_zero_day"], "YES").otherwise("no")),
        F.concat(F.lit("  Message:   "), c["message"]))


def alert_json(df: DataFrame, at: Column) -> Column:
    return F.to_json(F.struct(*[col(c) for c in df.columns], at.alias("formatted_at")))


def alert_csv(df: DataFrame) -> Column:
    c = _named(df)
    flag = F.when(c["is_zero_day"], "True").otherwise("False")
    fields = [c["alert_id"], c["sample_id"], c["severity"], c["predicted_class"], c["anomaly_score"].cast("string"),
              c["classification_confidence"].cast("string"), flag, c["message"]]
    named = [F.coalesce(f, F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)]
    return F.to_csv(F.struct(*named), {"emptyValue": "", "escape": '"'})  # a field with a comma or a quote is quoted


def formatted_alerts(df: DataFrame, fmt: str, at: Column) -> DataFrame:
    """(alert_id, line); an unknown format name means text."""
    line = {"json": lambda: alert_json(df, at), "csv": lambda: alert_csv(df)}.get(fmt, lambda: alert_text(df, at))()
    return df.select("alert_id", line.alias("line"))


# --- response -------------------------------------------------------------------------------------------------------

def response_actions(detections: DataFrame, log_alerts: bool = True, block_critical: bool = False,
                     quarantine_zero_day: bool = False) -> DataFrame:
    """Action rows of each anomalous or zero-day detection, in the order they are taken."""
    d = detections.filter("is_anomaly or is_zero_day")
    c = _named(d)
    severity = c["severity"]
    target = F.coalesce(*[c[n] for n in ("source_ip", "sample_id") if n in c], F.lit("unknown"))
    say = lambda before, after: F.concat(F.lit(before), severity, F.lit(after))

    def action(kind: str, condition: Column, parameters: Column, description: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("action_type"), target.alias("target"),
                                          parameters.alias("parameters"), description.alias("description")))

    none = F.create_map().cast("map<string,string>")
    by_severity = F.create_map(F.lit("severity"), severity)
    wanted = F.array(
        action("log", F.lit(log_alerts), none, say("Log ", " severity detection")),
        action("alert", severity.isin("critical", "high"), by_severity, say("Alert for ", " severity detection")),
        action("quarantine", c["is_zero_day"] & F.lit(quarantine_zero_day),
               F.create_map(F.lit("reason"), F.lit("zero_day_detection")), F.lit("Quarantine zero-day detection")),
        action("block", (severity == "critical") & F.lit(block_critical), by_severity, F.lit("Block critical severity source")))
    return (d.select(*[col(x) for x in d.columns], F.posexplode(wanted).alias("step", "_a")).filter("_a is not null")
            .select(*[col(x) for x in d.columns], "step", "_a.*"))


# --- time -----------------------------------------------------------------------------------------------------------

def parse_time(c: Column, fmt: str | None = None, epoch: bool = False) -> Column:
    """Epoch seconds, a given format, or ISO text."""
    if epoch:
        return F.timestamp_seconds(c)
    return F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)


def to_unix_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def format_duration(seconds: Column) -> Column:
    """ns, us and ms below a second, then seconds, minutes and hours."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return chain([
        (seconds < 1e-6, F.format_string("%.2f ns", seconds * 1e9)), (seconds < 1e-3, F.format_string("%.2f us", seconds * 1e6)),
        (seconds < 1.0, F.format_string("%.2f ms", seconds * 1e3)), (h > 0, F.format_string("%dh %dm %ds", h, m, s)),
        (m > 0, F.format_string("%dm %ds", m, s))], F.format_string("%.2fs", seconds))


# --- predictions as flat rows ---------------------------------------------------------------------------------------

def flat_detections(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "is_anomaly", "anomaly_score", "predicted_class", "classification_confidence", "severity",
                     "is_zero_day", "detection_latency_ms")


def flat_probabilities(df: DataFrame, probabilities: str, classes: list[str]) -> DataFrame:
    """The probability map as one ``prob_{class}`` column per class."""
    return df.select(*[col(c) for c in df.columns if c != probabilities],
                     *[col(probabilities).getItem(c).alias(f"prob_{c}") for c in classes])


def top_predictions(labels: Column, probabilities: Column, k: int = 3) -> Column:
    """Array of (probability, label), most probable first; equal probabilities in reverse label order."""
    pairs = F.arrays_zip(probabilities.alias("probability"), labels.alias("label"))
    return F.slice(F.reverse(F.array_sort(pairs)), 1, k)


def confidence_filter(df: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Adds low_confidence and, for these rows, original_label."""
    low = col("confidence") < min_confidence
    return df.withColumns({"low_confidence": low, "original_label": F.when(low, col("predicted_label"))})
