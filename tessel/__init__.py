"""Leakage-aware dataset preparation and analytics as Spark DataFrame operators."""
