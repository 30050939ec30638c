"""Spark-native analytics for spatial detections, tracks and event streams."""
