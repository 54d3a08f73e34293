"""siltstone: change-aware analysis of text and file collections on Spark."""

__version__ = "0.1.0"
