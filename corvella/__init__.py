"""Corvella: Spark-native analytics for scholarly corpora, citation networks and evidence tables."""
