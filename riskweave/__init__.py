"""Spark-native analytics for financial networks: every operator takes and returns DataFrames."""
