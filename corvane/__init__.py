"""Spark-native search and analysis of large collections of technical documents."""
