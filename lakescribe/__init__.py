"""Schema documentation for Spark: measure a lake or normalise catalog dumps, then document and audit."""

__version__ = "0.1.0"
