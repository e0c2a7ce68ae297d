"""Analytics over source code and text, written for Spark's DataFrame and SQL engine."""

__version__ = "0.1.0"
