"""Many pairs or groups of polygons measured at once, in numpy: no Python object for a point, a ring or a pair.

A scene is a pair of rings, or the rings of one cell. Its area is measured by a sweep: between two neighbouring heights of
vertices and crossings all edges are straight and apart, so that the width half way up times the height is exact. The
edges that reach into a strip are listed strip by strip, so memory follows their number and not strips times edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Pairs of edges compared at once, and pairs of boxes.
AT_ONCE, BOXES_AT_ONCE = 1 << 18, 1 << 16


class Rings(NamedTuple):
    """Rings one after the other: points, and where each ring begins (and the last one ends)."""

    x: np.ndarray
    y: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Rings:
        """Of an Arrow column array<struct<x, y>> without nulls."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        at = column.offsets.to_numpy().astype(np.int64)
        points = column.values.slice(at[0], at[-1] - at[0])
        x, y = (points.field(k).to_numpy(zero_copy_only=False)[: at[-1] - at[0]] for k in "xy")
        return cls(x, y, at - at[0])

    @classmethod
    def one(cls, points: np.ndarray) -> Rings:
        return cls(points[:, 0].copy(), points[:, 1].copy(), np.array([0, len(points)]))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ring, and both ends of each edge."""
        after = np.arange(1, len(self.x) + 1)
        full = np.diff(self.first) > 0
        after[self.first[1:][full] - 1] = self.first[:-1][full]
        return self.rows(), self.x, self.y, self.x[after], self.y[after]

    def take(self, rows: np.ndarray) -> Rings:
        """The rings in these places, in this order."""
        n = np.diff(self.first)[rows]
        first = np.append(0, np.cumsum(n))
        at = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], n)
        return Rings(self.x[at], self.y[at], first)

    def upright(self) -> np.ndarray:
        """Which rings are rectangles with sides along the axes, given by their four corners (and the first once more)."""
        n = np.diff(self.first)
        out = (n == 4) | (n == 5)
        at, last = self.first[:-1][out], self.first[1:][out] - 1
        out[out] = (n[out] == 4) | ((self.x[at] == self.x[last]) & (self.y[at] == self.y[last]))
        at = self.first[:-1][out]
        (x0, x1, x2, x3), (y0, y1, y2, y3) = ([v[at + k] for k in range(4)] for v in (self.x, self.y))
        out[out] = ((x0 == x1) & (y1 == y2) & (x2 == x3) & (y3 == y0)) | ((y0 == y1) & (x1 == x2) & (y2 == y3) & (x3 == x0))
        return out

    def areas(self) -> np.ndarray:
        row, x0, y0, x1, y1 = self.edges()
        # About the first point of each ring, so that far away rings lose no digits.
        start = np.minimum(self.first[:-1], max(len(self.x) - 1, 0))
        ox, oy = (self.x[start][row], self.y[start][row]) if len(self.x) else (x0, y0)
        return np.abs(np.bincount(row, (x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy), len(self.first) - 1)) / 2

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowest x and y and highest x and y; of a ring without points an empty box."""
        row, n = self.rows(), len(self.first) - 1
        out = []
        for values, find, none in ((self.x, np.minimum, np.inf), (self.y, np.minimum, np.inf), (self.x, np.maximum, -np.inf), (self.y, np.maximum, -np.inf)):
            side = np.full(n, none)
            find.at(side, row, values)
            out.append(side)
        return tuple(out)


def _lists(a: np.ndarray, b: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of members of two lists sorted by scene, all pairs of a scene, some at a time."""
    for low, high, n, j in _spans(np.searchsorted(b, a), np.searchsorted(b, a, side="right"), at_once):
        yield np.repeat(np.arange(low, high), n), j


def _spans(begin: np.ndarray, end: np.ndarray, at_once: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, n, j): the numbers j from begin to end of the spans low to high, n of each, some at a time."""
    size = end - begin
    done = np.cumsum(size)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + at_once, side="right")))
        n = size[low:high]
        yield low, high, n, np.arange(n.sum()) + np.repeat(begin[low:high] - (np.cumsum(n) - n), n)
        low = high


def _near(scene: np.ndarray, edges: tuple, box: tuple) -> tuple[np.ndarray, tuple]:
    """The edges that reach into the box of their scene."""
    x0, y0, x1, y1 = edges
    ok = (np.maximum(x0, x1) >= box[0][scene]) & (np.minimum(x0, x1) <= box[2][scene]) & (np.maximum(y0, y1) >= box[1][scene]) & (np.minimum(y0, y1) <= box[3][scene])
    return scene[ok], tuple(v[ok] for v in edges)


def _between(scene: np.ndarray, edges: tuple, box: tuple, *more: np.ndarray) -> tuple:
    """The edges between the lowest and the highest y of their scene, cut there. Level edges bound nothing."""
    low, high = box[1][scene], box[3][scene]
    ok = (np.maximum(edges[1], edges[3]) > low) & (np.minimum(edges[1], edges[3]) < high) & (edges[1] != edges[3])
    scene, low, high = scene[ok], low[ok], high[ok]
    x0, y0, x1, y1 = (v[ok] for v in edges)
    ya, yb = np.clip(y0, low, high), np.clip(y1, low, high)
    slope = (x1 - x0) / (y1 - y0)
    return scene, (np.where(ya == y0, x0, x0 + (ya - y0) * slope), ya, np.where(yb == y1, x1, x0 + (yb - y0) * slope), yb), *(v[ok] for v in more)


def crossings(sa: np.ndarray, a: tuple, sb: np.ndarray, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(scene, height) at which edges of a and of b cross."""
    scenes, heights = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for i, j in _lists(sa, sb, AT_ONCE):
        px, py, rx, ry = a[0][i], a[1][i], a[2][i] - a[0][i], a[3][i] - a[1][i]
        qx, qy, sx, sy = b[0][j], b[1][j], b[2][j] - b[0][j], b[3][j] - b[1][j]
        det = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((qx - px) * sy - (qy - py) * sx) / det
            u = ((qx - px) * ry - (qy - py) * rx) / det
            ok = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        scenes.append(sa[i[ok]])
        heights.append(py[ok] + t[ok] * ry[ok])
    return np.concatenate(scenes), np.concatenate(heights)


def sweep(scenes: int, scene: np.ndarray, ring: np.ndarray, edges: tuple, more: tuple[np.ndarray, np.ndarray], least: int, sides: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """For each scene the area that `least` of its rings or more cover (even-odd). more: (scene, height) of crossings.
    sides: lowest and highest x that count, by scene."""
    x0, y0, x1, y1 = edges
    own, y = np.concatenate([scene, scene, more[0]]), np.concatenate([y0, y1, more[1]])
    order = np.lexsort((y, own))
    new = np.ones(len(y), dtype=bool)
    new[1:] = (own[order][1:] != own[order][:-1]) | (y[order][1:] != y[order][:-1])
    number = np.empty(len(y), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    height, of = y[order][new], own[order][new]
    low, high = np.minimum(number[: len(y0)], number[len(y0) : 2 * len(y0)]), np.maximum(number[: len(y0)], number[len(y0) : 2 * len(y0)])
    area = np.zeros(scenes)
    # Strips are numbered by their lower height; some edges at a time.
    if not len(height):
        return area
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    reach = np.bincount(scene, high - low, scenes)[of[cuts]]
    done, k = np.cumsum(reach), 0
    by_scene = np.argsort(scene, kind="stable")
    sorted_scene = scene[by_scene]
    while k < len(cuts):
        j = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + 4 * AT_ONCE, side="right")))
        some = by_scene[np.searchsorted(sorted_scene, of[cuts[k]]) : np.searchsorted(sorted_scene, of[cuts[j - 1]], side="right")]
        n = high[some] - low[some]
        e = np.repeat(some, n)
        strip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[e]
        middle = (height[strip] + height[np.minimum(strip + 1, len(height) - 1)]) / 2
        x = x0[e] + (middle - y0[e]) * (x1[e] - x0[e]) / (y1[e] - y0[e])
        if sides is not None:
            x = np.clip(x, sides[0][scene[e]], sides[1][scene[e]])
        order = np.lexsort((x, ring[e], strip))
        strip, x = strip[order], x[order]
        # Along a strip a ring's edges lead in and out by turns.
        sign = np.where(np.arange(len(x)) % 2 == 0, 1, -1)
        order = np.lexsort((x, strip))
        strip, x, covered = strip[order], x[order], np.cumsum(sign[order])
        inside = (covered[:-1] >= least) & (strip[1:] == strip[:-1])
        at = strip[:-1][inside]
        area += np.bincount(of[at], (x[1:] - x[:-1])[inside] * (height[at + 1] - height[at]), scenes)
        k = j
    return area


def overlap_areas(a: Rings, b: Rings) -> np.ndarray:
    """Area of the intersection of each ring of a with the ring of b in the same place."""
    n = len(a.first) - 1
    boxes = tuple(f(p, q) for f, p, q in zip((np.maximum, np.maximum, np.minimum, np.minimum), a.boxes(), b.boxes(), strict=True))
    real = (np.diff(a.first) >= 3) & (np.diff(b.first) >= 3) & (boxes[0] < boxes[2]) & (boxes[1] < boxes[3])
    scene, ring, sides, near = [], [], [], []
    for side, rings in enumerate((a, b)):
        own, *edges = rings.edges()
        use = real[own]
        own, edges = own[use], tuple(v[use] for v in edges)
        near.append(_near(own, edges, boxes))
        own, edges = _between(own, edges, boxes)
        scene.append(own)
        ring.append(np.full(len(own), side))
        sides.append(edges)
    own, y = crossings(*near[0], *near[1])
    every = tuple(np.concatenate(v) for v in zip(*sides, strict=True))
    return sweep(n, np.concatenate(scene), np.concatenate(ring), every, (own, y), 2)


def _places(cell: np.ndarray, x: np.ndarray, of: np.ndarray, at: np.ndarray, after: bool = False) -> np.ndarray:
    """np.searchsorted in values that are sorted by cell: where (of, at) goes in (cell, x), before its equals or after."""
    kind = np.repeat([not after, after], [len(cell), len(of)])
    order = np.lexsort((kind, np.concatenate([x, at]), np.concatenate([cell, of])))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(order < len(cell))
    return out[len(cell) :]


class Placed(NamedTuple):
    """Boxes in cells, sorted by cell and lowest x. at: their rows; begins: 1 if the lowest x lies in the cell, plus 2 if
    the lowest y does."""

    at: np.ndarray
    cell: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, *columns: np.ndarray) -> Placed:
        order = rows[np.lexsort((columns[1][rows], columns[0][rows]))]
        return cls(order, *(c[order] for c in columns))

    def pairs(self, other: Placed | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows of the other, width, height) of common parts whose lower corner lies in the cell, some at a time:
        every pair once. Without another of these boxes among themselves. No box is empty."""
        if other is None:
            yield from self._pairs(self, np.arange(1, len(self.at) + 1))
            return
        yield from self._pairs(other, _places(other.cell, other.x0, self.cell, self.x0))
        for j, i, width, height in other._pairs(self, _places(self.cell, self.x0, other.cell, other.x0, after=True)):
            yield i, j, width, height

    def _pairs(self, later: Placed, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The later ones begin at or to the right of the lowest x of these, from `begin` on."""
        for low, high, n, j in _spans(begin, _places(later.cell, later.x0, self.cell, self.x1), BOXES_AT_ONCE):
            each = lambda v: np.repeat(v[low:high], n)  # noqa: B023, E731
            height = np.minimum(each(self.y1), later.y1[j]) - np.maximum(each(self.y0), later.y0[j])
            ok = np.flatnonzero((height > 0) & ((each(self.begins) | later.begins[j]) == 3))
            i, j = np.repeat(np.arange(low, high), n)[ok], j[ok]
            yield self.at[i], later.at[j], np.minimum(self.x1[i], later.x1[j]) - later.x0[j], height[ok]


def overlap_areas_of(rings: Rings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """overlap_areas of the rings i and j, some at a time."""
    size = np.diff(rings.first)
    part = np.cumsum(size[i] + size[j]) // AT_ONCE
    cuts = np.flatnonzero(np.diff(part)) + 1
    return np.concatenate([np.zeros(0), *(overlap_areas(rings.take(a), rings.take(b)) for a, b in zip(np.split(i, cuts), np.split(j, cuts), strict=True))])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about so many rows of batches that are sorted by whole-numbered keys, no group in two of them, and the
    number of each row's group."""
    held, starts, last, n = [], [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        new = np.append(last != [v[0] for v in values], np.any([v[1:] != v[:-1] for v in values], axis=0))
        last = [v[-1] for v in values]
        begins = np.flatnonzero(new)
        if n >= rows and len(begins):
            at = int(begins[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, at)]), np.cumsum(np.concatenate([*starts, new[:at]]))
            held, starts, n, batch, new = [], [], 0, batch.slice(at), new[at:]
        held.append(batch)
        starts.append(new)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held), np.cumsum(np.concatenate(starts))


def meeting(a: Rings, b: Rings) -> np.ndarray:
    """Whether each ring of a has a point in common with the ring of b in the same place, edges included."""
    n = len(a.first) - 1
    box_a, box_b = a.boxes(), b.boxes()
    boxes = tuple(f(p, q) for f, p, q in zip((np.maximum, np.maximum, np.minimum, np.minimum), box_a, box_b, strict=True))
    real = (np.diff(a.first) >= 3) & (np.diff(b.first) >= 3) & (boxes[0] <= boxes[2]) & (boxes[1] <= boxes[3])
    out, near = np.zeros(n, dtype=bool), []
    for rings, other in ((a, b), (b, a)):
        own, *edges = rings.edges()
        use = real[own]
        own, edges = own[use], tuple(v[use] for v in edges)
        near.append(_near(own, edges, boxes))
        # The other ring lies inside if its first point does.
        if len(own):
            start = other.first[own]
            x, y = other.x[start], other.y[start]
            with np.errstate(divide="ignore", invalid="ignore"):
                cut = ((edges[1] > y) != (edges[3] > y)) & (x < (edges[2] - edges[0]) * (y - edges[1]) / (edges[3] - edges[1]) + edges[0])
            out |= np.bincount(own[cut], minlength=n) % 2 == 1
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    (sa, ea), (sb, eb) = near
    for i, j in _lists(sa, sb, AT_ONCE):
        p, q, r, s = (ea[0][i], ea[1][i]), (ea[2][i], ea[3][i]), (eb[0][j], eb[1][j]), (eb[2][j], eb[3][j])
        touch = (turn(p, q, r) * turn(p, q, s) <= 0) & (turn(r, s, p) * turn(r, s, q) <= 0)
        for k in (0, 1):
            touch &= (np.maximum(p[k], q[k]) >= np.minimum(r[k], s[k])) & (np.maximum(r[k], s[k]) >= np.minimum(p[k], q[k]))
        out[sa[i[touch]]] = True
    return out


def union_areas(scene: np.ndarray, rings: Rings, box: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each scene the area that its rings cover together inside a box (lowest x and y, highest x and y, by scene).
    scene: of each ring, in ascending order."""
    n = len(box[0])
    ring, *edges = rings.edges()
    own, edges, ring = _between(scene[ring], tuple(edges), box, ring)
    xa, ya, xb, yb = edges
    # Heights at which edges cross each other, and the box's sides.
    near, inside = _near(own, edges, box)
    of, heights = ([v] for v in crossings(near, inside, near, inside))
    for side in (box[0], box[2]):
        at = side[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = ya + (at - xa) * (yb - ya) / (xb - xa)
        ok = (np.minimum(xa, xb) < at) & (np.maximum(xa, xb) > at)
        of.append(own[ok])
        heights.append(y[ok])
    return sweep(n, own, ring, edges, (np.concatenate(of), np.concatenate(heights)), 1, (box[0], box[2]))
