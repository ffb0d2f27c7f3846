"""A Spark-native analytics engine for longitudinal measurement data."""
