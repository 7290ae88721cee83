"""Spark-native analytics for market-microstructure data."""
