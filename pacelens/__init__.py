"""Behavioural timing analytics as Spark DataFrame operators."""
