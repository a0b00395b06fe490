"""Scalar functions over columns, without Python on the executors except for real bit packing."""

from .bits import bit_ceiling, bit_width, pack, unpack
from .maps import find, find_value, insert, remove
from .numbers import approximate, doubles, key_of_timestamp, residual, sign_of, slope, text_of_big, truncated_div, words
from .zorder import morton, next_in_box, unmorton

__all__ = ["approximate", "bit_ceiling", "bit_width", "doubles", "find", "find_value", "insert", "key_of_timestamp", "morton", "next_in_box", "pack", "remove", "residual", "sign_of", "slope", "text_of_big", "truncated_div", "unmorton", "unpack", "words"]
