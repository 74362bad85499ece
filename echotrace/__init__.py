"""Partial near-duplicate search over timestamped vectors, as Spark plans."""

__version__ = "0.1.0"
