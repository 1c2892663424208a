"""mediaspark: a PySpark-native analytics engine for large media libraries."""

__version__ = "0.1.0"
