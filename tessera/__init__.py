"""PySpark-native analytics over versioned, license-governed knowledge tables."""
