"""Spark-native affiliation analytics: raw affiliation strings to structured, registry-linked records."""
