"""They must equal the published ones for results to agree."""

# Labels.
BENIGN = "BENIGN"
KNOWN_ATTACKS = ["DoS Hulk", "DoS GoldenEye", "DoS Slowloris", "DoS Slowhttptest", "Heartbleed"]
RAW_LABEL_COLUMN = " Label"
LABEL_COLUMN = "Label"
ZERO_DAY = "ZERO_DAY"
UNKNOWN = "UNKNOWN"

# The thirty flow features a model is trained on.
FLOW_FEATURES = [
    "Fwd Packet Length Mean", "Fwd Packet Length Std", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Flow IAT Mean", "Flow IAT Std",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std",
    "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Subflow Fwd Bytes", "Subflow Bwd Bytes",
    "Subflow Fwd Packets", "Subflow Bwd Packets", "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "Fwd Packets/s", "Bwd Packets/s", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "Down/Up Ratio", "Average Packet Size",
]
# Columns that identify a flow and never become features.
IDENTITY_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Source Port", "Destination Port", "Protocol",
                    "Timestamp"]
# Forward / backward pairs of the default ratio features.
DIRECTION_PAIRS = [
    ("Fwd Packet Length Mean", "Bwd Packet Length Mean"),
    ("Total Fwd Packets", "Total Backward Packets"),
    ("Fwd Packets/s", "Bwd Packets/s"),
    ("Subflow Fwd Bytes", "Subflow Bwd Bytes"),
]

# Severity: lowest score of each level, from the most to the least severe.
SEVERITY_MIN_SCORE = {"critical": 0.9, "high": 0.7, "medium": 0.5, "low": 0.3}
SEVERITY_RANKED = ["low", "medium", "high", "critical"]
SEVERITY_ICONS = {"critical": "[!!!]", "high": "[!! ]", "medium": "[!  ]", "low": "[   ]"}
UNKNOWN_ICON = "[?] "
ZERO_DAY_BOOST = 0.2
ZERO_DAY_CONFIDENCE = 0.7

# Alerting.
MIN_CONFIDENCE = 0.5
COOL_DOWN_SECONDS = 10
ALERTS_PER_MINUTE = 60
ACTIONS_PER_MINUTE = 60
ALERT_COLUMNS = ["timestamp", "alert_id", "severity", "predicted_class", "anomaly_score",
                 "classification_confidence", "is_zero_day", "sample_id", "message"]

# Models.
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.1
SEED = 42
THRESHOLD_PERCENTILE = 95.0
CLASSIFIER_TREES = 150
CLASSIFIER_DEPTH = 20
CLASSIFIER_LEAF = 2
CLASSIFIER_SPLIT = 5

# Splits, feature selection, threshold search.
TEST_SIZE = 0.2
VAL_SIZE = 0.1
KEEP_FEATURES = 30
MAX_CORRELATION = 0.95
MIN_VARIANCE = 0.01
THRESHOLD_STEP = 0.001
SENSITIVITY_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
