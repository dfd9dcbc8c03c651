"""Agent-telemetry analytics on Spark: canonical records in, keyed tables out."""

__version__ = "0.1.0"
