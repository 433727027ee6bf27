"""Plumbline: a PySpark-native auditor for machine-learning training datasets."""

__version__ = "0.1.0"
