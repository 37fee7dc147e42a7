"""Queries over the supplied tables, each with an SQL twin."""
