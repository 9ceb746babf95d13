"""PySpark-native analytics over versioned vulnerability findings."""
