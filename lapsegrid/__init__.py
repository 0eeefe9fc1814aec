"""Analytics on entities observed repeatedly over time, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
