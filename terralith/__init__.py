"""terralith: a PySpark-native engine for spatial and scene data."""
