"""A Spark-native engine for text-embedding search."""
