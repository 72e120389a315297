"""A PySpark-native engine for knowledge and memory retrieval."""
