"""terrano: a Spark-native engine for property-listing data."""
