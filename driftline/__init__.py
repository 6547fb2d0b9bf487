"""Spark-native analytics for state-space time series and text corpora."""
