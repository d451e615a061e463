"""Spark-native analytics over evidence-bearing text memories."""
