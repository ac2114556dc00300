"""Spark-native analytics over panels of OHLCV bars."""
