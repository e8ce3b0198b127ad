"""Spark-first analytics and machine learning."""
