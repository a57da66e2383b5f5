"""Corvane: Spark-native mobility and decarbonisation analytics."""
