"""Sparse count-matrix analytics on Spark."""
