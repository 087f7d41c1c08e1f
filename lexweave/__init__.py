"""Versioned, citable document corpora as Spark DataFrame operators."""
