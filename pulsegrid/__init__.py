"""pulsegrid: a PySpark-native engine for weak labelling of time-series data and for preparing training data."""
