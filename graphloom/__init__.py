"""Spark-native analytics over code property graphs and source corpora."""
