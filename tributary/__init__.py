"""tributary: a PySpark-native analytics engine for logs and event tables."""

__version__ = "0.1.0"
