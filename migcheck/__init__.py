"""A PySpark-native engine for validating table migrations."""
