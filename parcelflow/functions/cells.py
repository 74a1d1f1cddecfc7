"""Cells of a grid over the world in Z-order: near places have near numbers, and a box is a few ranges of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halvings of each axis: a cell is some 38 m high, and as wide at the equator's double.
BITS = 20


def _axis(value: Column, low: float, span: float, bits: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((value - low) / span * 2**bits))).cast("long")


def _spread(value: Column, bits: int) -> Column:
    """The bits of a number with a zero before each."""
    moved = [F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1).cast("long")), 2 * i) for i in range(bits)]
    while len(moved) > 1:
        moved = [a.bitwiseOR(b) for a, b in zip(moved[::2], moved[1::2])] + ([moved[-1]] if len(moved) % 2 else [])
    return moved[0]


def cell(latitude: Column, longitude: Column, bits: int = BITS) -> Column:
    """The cell of a place; null without both coordinates. Places beyond the world lie in its outermost cells."""
    y, x = _axis(latitude.cast("double"), -90.0, 180.0, bits), _axis(longitude.cast("double"), -180.0, 360.0, bits)
    placed = latitude.isNotNull() & longitude.isNotNull()
    return F.when(placed, F.shiftleft(_spread(y, bits), 1).bitwiseOR(_spread(x, bits)))


def ranges(bounds: tuple[float, float, float, float], most: int = 32, bits: int = BITS) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cells, both ends counted, that cover (south, west, north, east), ascending; none for a box
    with an end before its beginning. Squares that the box cuts are quartered, the largest first, while there is room."""
    south, west, north, east = bounds
    if south > north or west > east:
        return []
    at = lambda v, low, span: max(0, min(2**bits - 1, int((v - low) / span * 2**bits // 1)))
    box = (at(south, -90.0, 180.0), at(west, -180.0, 360.0), at(north, -90.0, 180.0), at(east, -180.0, 360.0))

    def inside(y: int, x: int, size: int) -> bool:
        return box[0] <= y and y + size - 1 <= box[2] and box[1] <= x and x + size - 1 <= box[3]

    def meets(y: int, x: int, size: int) -> bool:
        return y <= box[2] and y + size > box[0] and x <= box[3] and x + size > box[1]

    cut, whole = [(0, 0, 0, 2**bits)], []  # first cell, row, column, side
    while cut and len(_joined(cut + whole)) <= most:
        largest = max(side for *_, side in cut)
        split = [s for s in cut if s[3] == largest]
        half, parts = largest // 2, []
        for first, y, x, _ in split:
            parts += [(first + q * half * half, y + (q >> 1) * half, x + (q & 1) * half, half) for q in range(4)]
        parts = [s for s in parts if meets(*s[1:])]
        done = [s for s in parts if inside(*s[1:]) or s[3] == 1]
        rest = [s for s in cut if s[3] < largest] + [s for s in parts if s not in done]
        if len(_joined(rest + whole + done)) > most:
            break
        cut, whole = rest, whole + done
    return _joined(cut + whole)


def _joined(squares: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Squares as ranges of cells, neighbours in one."""
    out: list[tuple[int, int]] = []
    for first, _, _, side in sorted(squares):
        if out and out[-1][1] == first - 1:
            out[-1] = (out[-1][0], first + side * side - 1)
        else:
            out.append((first, first + side * side - 1))
    return out


def within(column: Column, bounds: tuple[float, float, float, float], most: int = 32) -> Column:
    """Whether a stored cell may lie in a box: comparisons that reach a scan. Borders of cells and boxes differ, so that the
    coordinates must be tested too."""
    test = F.lit(False)
    for first, last in ranges(bounds, most):
        test = test | column.between(first, last)
    return test
