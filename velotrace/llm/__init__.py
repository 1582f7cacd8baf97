"""Operators for preparing large text, token and embedding corpora on Spark."""
