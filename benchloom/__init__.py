"""Benchmark and evaluation analytics as Spark DataFrame jobs."""
