"""Spark-first engine for building, searching and evaluating document collections."""
