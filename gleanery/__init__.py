"""gleanery: a PySpark-native engine that turns fetched web payloads into clean records."""
