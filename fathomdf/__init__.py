"""A PySpark-native analytics and retrieval engine."""
