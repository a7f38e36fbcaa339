"""loam: a PySpark-native engine for full-text search and incremental maintenance of file collections."""

__version__ = "0.1.0"
