"""A PySpark-native engine for preservation metadata graphs and described binary data."""
