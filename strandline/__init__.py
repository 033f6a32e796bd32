"""Spark-native segmentation of activity in frame-level time series."""
