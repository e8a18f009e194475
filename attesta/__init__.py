"""Claim verification on Spark: clean, classify, find evidence, score, serve, evaluate."""

__version__ = "0.1.0"
