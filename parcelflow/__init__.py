"""A PySpark-native analytics engine for civic permit records."""
