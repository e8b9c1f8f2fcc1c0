"""A PySpark-native toolkit for data exchange: partitioning, keyed aggregation, sorting and a durable exchange store."""

__version__ = "0.1.0"
