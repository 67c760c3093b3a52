"""Spark-native analytics for market time series and the texts around them."""
