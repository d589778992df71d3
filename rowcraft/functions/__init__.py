"""Predicates and conversions as Spark expressions."""
