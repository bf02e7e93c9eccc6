"""Lamella: a PySpark-native engine for per-cell measurement analytics."""
