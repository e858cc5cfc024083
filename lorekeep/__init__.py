"""lorekeep: a PySpark-native engine for document knowledge bases."""
