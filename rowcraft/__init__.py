"""Typed table access and training-data preparation on Spark."""
