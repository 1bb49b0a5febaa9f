"""Structured-document queries compiled to Spark DataFrame expressions."""
