"""Tessella: a PySpark-native analytics engine for research corpora and their evaluation."""
