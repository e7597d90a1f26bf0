"""Spreadsheet-style models evaluated as Spark plans."""

__version__ = "0.1.0"
