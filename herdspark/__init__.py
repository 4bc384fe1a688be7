"""Spark-native quality, rule, split, model and record analytics for herd data."""
