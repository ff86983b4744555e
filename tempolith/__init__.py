"""A PySpark-native analytics engine for work-item history."""
