"""Spark-native specification analytics: symbol graphs, prose retrieval, catalogs and usage reports."""
