"""A PySpark-native engine for exact set-similarity joins."""
