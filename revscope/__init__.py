"""Telemetry analytics on Spark: sources, features, events, reports, suggestions and patches."""
