"""Spark-first analytics over public indicator feeds."""
