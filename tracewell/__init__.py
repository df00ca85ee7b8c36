"""Corpus, catalogue and traceability analytics as plain Spark DataFrame operators."""
