"""A Spark-native engine for exploring time series."""
