"""rillwatch: flow-anomaly analytics as PySpark DataFrame operators and Structured Streaming jobs."""

__version__ = "0.1.0"
