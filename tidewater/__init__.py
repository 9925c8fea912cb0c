"""tidewater: a PySpark-native engine for preparing training data."""
