"""A PySpark-native engine for information-theoretic comparison of text collections."""
