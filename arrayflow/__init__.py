"""Tensor datasets and pipeline telemetry as Spark DataFrame operators."""
