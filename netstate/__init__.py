"""Network-state analytics on PySpark: flows and packets in, window states, splits, audits and forecasts out."""

__version__ = "0.1.0"
