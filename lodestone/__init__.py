"""lodestone: a PySpark-native engine for file, text and document collections."""

__version__ = "0.1.0"
