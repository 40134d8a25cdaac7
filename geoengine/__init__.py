"""Spark-native analytics for geospatial tables, road networks and pixel tables."""
