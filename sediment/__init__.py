"""sediment: a PySpark-native analytics engine for long-term memory stores of agents."""

__version__ = "0.1.0"
