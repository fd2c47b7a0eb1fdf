"""lectern: a PySpark-native engine for building and querying a literature corpus."""
