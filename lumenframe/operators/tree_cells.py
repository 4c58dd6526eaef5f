"""Cells between the cuts of trees.

Rows that lie between the same cuts in every column take the same way through every tree, so what trees say of a row needs to be
worked out once per cell. How many cells occur depends on the cuts and the values, not on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np

#: Cells are numbered below this; columns that make more have no numbers.
NUMBERS = 1 << 62
#: Cells whose values one task keeps.
MOST_KEPT = 1 << 18


def cell_count(cuts: list[np.ndarray]) -> int:
    """How many cells the cuts make; a gap in the data has a place of its own."""
    return math.prod(len(c) + 2 for c in cuts)


def cell_places(columns: Iterable[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Per column the number of cuts below each value."""
    return [np.where(np.isnan(v), len(c) + 1, np.searchsorted(c, v, side="left")) for v, c in zip(columns, cuts)]


def cell_numbers(columns: Iterable[np.ndarray], cuts: list[np.ndarray], rows: int) -> np.ndarray:
    """The number of each row's cell, for cuts that make fewer than ``NUMBERS``."""
    number = np.zeros(rows, np.int64)
    for at, c in zip(cell_places(columns, cuts), cuts):
        number = number * (len(c) + 2) + at
    return number


class CellValues:
    """A function of rows that is asked once per cell, as long as the cells met so far are not too many to keep."""

    def __init__(self, cuts: list[np.ndarray], value: Callable[[np.ndarray], np.ndarray], most: int = MOST_KEPT):
        self.cuts, self.value, self.most, self.numbered = cuts, value, most, cell_count(cuts) < NUMBERS
        self.kept, self.values = np.zeros(0, np.int64), np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.numbered:
            return self.value(x)
        number = cell_numbers(x.T, self.cuts, len(x))
        at = np.searchsorted(self.kept, number)
        known = np.append(self.kept, -1)[at] == number
        out = np.append(self.values, 0.0)[at]
        new = np.flatnonzero(~known)
        if len(new):
            found, first, inverse = np.unique(number[new], return_index=True, return_inverse=True)
            values = self.value(x[new[first]])
            out[new] = values[inverse]
            if len(self.kept) + len(found) <= self.most:
                order = np.argsort(np.r_[self.kept, found], kind="stable")
                self.kept, self.values = np.r_[self.kept, found][order], np.r_[self.values, values][order]
        return out
