"""urlloom: WHATWG URL analytics expressed as PySpark columns, tables and streams."""

__version__ = "0.1.0"
