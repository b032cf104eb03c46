"""A Spark-native engine for crawled web corpora."""
