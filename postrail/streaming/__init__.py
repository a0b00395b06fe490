"""Postings that arrive over time: each micro-batch becomes an immutable part of the index."""

from .append import append, load_appended, store_batch

__all__ = ["append", "load_appended", "store_batch"]
