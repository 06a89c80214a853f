"""Benchmark-regression and test-log analytics as Spark DataFrame operators."""
