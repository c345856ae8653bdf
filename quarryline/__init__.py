"""quarryline: a PySpark-native evidence-analytics engine."""

__version__ = "0.1.0"
