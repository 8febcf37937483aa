"""Spark-native statistics on torsion angles and ordered per-position sequences."""
