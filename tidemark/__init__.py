"""Point-in-time composite-indicator analytics on PySpark."""

__version__ = "0.1.0"
