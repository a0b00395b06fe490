"""Operators over posting lists: model building, decoding, set algebra, search, statistics and points."""
