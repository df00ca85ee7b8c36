"""Spark operators, grouped by kind."""
