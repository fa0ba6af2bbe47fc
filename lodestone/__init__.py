"""Correlation analytics on Spark."""
