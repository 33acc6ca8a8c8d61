"""Point-in-time evidence and event-study analytics on PySpark DataFrames."""

__version__ = "0.1.0"
