"""Spark-native duplicate analytics for query-grouped sequencing alignments."""

__version__ = "0.1.0"
