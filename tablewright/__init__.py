"""Tabular analytics as Spark DataFrame operators."""
