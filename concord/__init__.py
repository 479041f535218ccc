"""Workload conformance and run analytics as Spark DataFrame jobs."""
