"""Claim and import analytics written as plain Spark DataFrame jobs."""

__version__ = "0.1.0"
