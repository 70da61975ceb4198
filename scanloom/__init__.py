"""Spark-first analytics over time-ordered observations, and a text subpackage beside it."""
