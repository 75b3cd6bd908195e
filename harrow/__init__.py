"""A Spark-native engine for evaluating information extraction from web pages."""
