"""A Spark-native engine for append-only event logs."""
