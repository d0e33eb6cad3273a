"""trajecta: a PySpark-native engine for agent-trajectory data sets."""

__version__ = "0.1.0"
