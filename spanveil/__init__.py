"""Sensitive-text detection and redaction for tables and streams of text on Spark."""
