"""Columns of many values as one cell a page: for the engine such a cell is bytes that it copies, not values that it converts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SIDES = ("size", "x0", "y0", "x1", "y1")
#: The packed columns of a page's glyphs.
PACKED = ("code", *SIDES, "region")
#: The types of a packed column: the first where that keeps all values as they are, else the second.
NUMBERS, REALS = ("<u1", "<i4"), ("<f4", "<f8")


def _types(name: str) -> tuple[np.dtype, np.dtype]:
    return tuple(np.dtype(t) for t in (REALS if name in SIDES else NUMBERS))


def packed(name: str, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values of each page as the bytes of one cell; ends: where pages begin, and the last one ends."""
    narrow, wide = _types(name)
    with np.errstate(over="ignore", invalid="ignore"):
        less = values.astype(narrow)
    own = less if np.array_equal(less, values) else values.astype(wide)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * own.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])


def unpacked(name: str, cells: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The values of all pages, one page after the other; counts: how many each has."""
    narrow, wide = _types(name)
    cells = cells.cast(pa.binary())
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    data = memoryview(cells.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])]
    for own in (narrow, wide):
        if (np.diff(ends) == counts * own.itemsize).all():
            return np.frombuffer(data, own).astype(wide, copy=False)
    pages = zip((ends - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), counts.tolist(), strict=False)
    return np.concatenate([np.frombuffer(data[a:z], wide if z - a == n * wide.itemsize else narrow).astype(wide) for a, z, n in pages])
