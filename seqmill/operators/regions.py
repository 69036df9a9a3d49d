"""Connected regions of grids, by merging runs in a scan over rows: only the row before is held."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqmill.operators.scans import Fold, scan


class _Boxes(Fold):
    """Boxes (left, top, right, bottom, x of the first cell) of the regions that the last row may still extend."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.row, self.runs = threshold, None, []
        self.boxes: dict[int, tuple] = {}
        self.made, self.count, self.best = 0, 0, None

    def _close(self, alive: set[int]) -> None:
        for region in [r for r in self.boxes if r not in alive]:
            left, top, right, bottom, x = self.boxes.pop(region)
            found = ((right - left + 1) * (bottom - top + 1), top, x, left, right, bottom)
            self.count, self.best = self.count + 1, found if self.best is None else max(self.best, found)

    def add(self, row: tuple) -> Iterable[tuple]:
        y, values = row
        on = np.concatenate(([False], np.array(values or [], dtype=np.float64) > self.threshold, [False]))
        edges = np.flatnonzero(on[1:] != on[:-1]).tolist()
        above = self.runs if self.row is not None and y == self.row + 1 else []
        into: dict[int, int] = {}

        def root(region: int) -> int:
            while region in into:
                region = into[region]
            return region

        runs, i = [], 0
        for low, end in zip(edges[::2], edges[1::2], strict=True):
            own, self.made = self.made, self.made + 1
            self.boxes[own] = (low, y, end - 1, y, low)
            while i < len(above) and above[i][1] < low:
                i += 1
            for j in range(i, len(above)):
                if above[j][0] > end:
                    break
                old = root(above[j][2])
                if old != own:
                    a, b = self.boxes.pop(old), self.boxes[own]
                    top, x = min((a[1], a[4]), (b[1], b[4]))
                    self.boxes[own] = (min(a[0], b[0]), top, max(a[2], b[2]), y, x)
                    into[old] = own
            runs.append((low, end, own))
        self.runs = [(low, end, root(region)) for low, end, region in runs]
        self.row = y
        self._close({region for _, _, region in self.runs})
        return ()

    def end(self) -> Iterable[tuple]:
        self._close(set())
        if self.best is None:
            return [(0, 0, 0, 0)]
        area, top, _, left, right, bottom = self.best
        return [(left + (right - left + 1) // 2, top + (bottom - top + 1) // 2, area, self.count)]


def largest_region(rows: DataFrame, keys: list[str], y: str, values: str, threshold: float = 0.0) -> DataFrame:
    """Centre (x, y) and area of the largest bounding box of a region of values over ``threshold``, and the number of regions.

    ``rows`` has one row per line of a grid; cells that touch, at corners too, are one region. Of
    equal boxes the one whose first cell in reading order comes last is taken. A grid without such
    cells gives zeros; nulls are no such cells; a missing line ends every region, as does a line given twice.
    """
    schema = StructType([StructField(n, LongType()) for n in ("x", "y", "area", "n_regions")])
    lines = rows.select(*keys, F.col(y).cast("long").alias("_y"), F.col(values).cast("array<double>").alias("_values")).where("_y IS NOT NULL")
    return scan(lines, keys, ["_y"], lambda: _Boxes(threshold), schema)
