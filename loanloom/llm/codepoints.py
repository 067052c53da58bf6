"""Code-point arrays: texts as numpy arrays and tables indexed by code point."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# fixed values: the code points with Unicode's White_Space property
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

# fixed values: letters and numbers that Unicode 16 added, which the tokenizer library knows
# and Python's tables (15.1) do not
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def array_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def text_from(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=None)
def classes() -> np.ndarray:
    """Class of every code point in Unicode 16: letter, number, white space or other."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=None)
def lower() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point, else itself."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        small = chr(point).lower()
        if len(small) == 1:
            table[point] = ord(small)
    return table
