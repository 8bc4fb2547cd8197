"""Corpus and telemetry analytics as lazy Spark DataFrame operators."""
