"""pagelathe: a PySpark-native engine that turns raw web pages into records."""

__version__ = "0.1.0"
