"""Spark-first analytics over financial-statement tables, plus a training-data subpackage."""
