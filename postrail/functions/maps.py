"""A keyed store in a map column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def insert(store: Column, key: Column, value: Column) -> Column:
    """The store with the key's value set, whether it was there or not."""
    return F.map_concat(remove(store, key), F.create_map(key, value))


def find(store: Column, key: Column) -> Column:
    """Whether the key is there."""
    return F.map_contains_key(store, key)


def find_value(store: Column, key: Column) -> Column:
    """The key's value, or null."""
    return F.try_element_at(store, key)


def remove(store: Column, key: Column) -> Column:
    return F.map_filter(store, lambda k, _: k != key)
