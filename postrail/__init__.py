"""Learned posting lists on Spark: compression by error-bounded lines, set queries, search and statistics."""

__version__ = "0.1.0"
