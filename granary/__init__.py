"""A PySpark-native retail analytics engine."""
