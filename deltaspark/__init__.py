"""A PySpark-native engine for analytics over changing collections."""
