"""Spark-native analytics for personalised speech-mishearing data."""
