"""Spark-native time-series metrics engine: windowed and incremental aggregates, retention, catalog and in-flight text."""
