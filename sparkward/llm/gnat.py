"""A multiway hyperplane tree over integer vectors that skips what no window of scores can reach.

Inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0)
give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a window of scores is an annulus around q'.

A node has up to FAN split points; a row goes to the nearest, down to a leaf ("cell"). For each split
point i and each sibling subtree j the node keeps the least and the largest distance between the
point and the rows of the subtree. A subtree is skipped if for some i the annulus cannot meet that
range: nothing in it is nearer to q than max(d - largest, least - d), nor farther than d + largest,
where d is the distance of q and the point. Distances carry some rounding, for which SLACK is left;
scores themselves are exact integers, so what a search returns is exact.

Split points come from a sample of at most SAMPLE rows and SAMPLE_BYTES, taken by a hash of the id; the
ranges are measured over all rows. So the tree has a bounded size, is the same in every run, and a
poor sample costs work, never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SAMPLE = 4096
SAMPLE_BYTES = 16 << 20
#: Split points of a node, and the sample rows from which on a cell is not split.
FAN, SMALL = 8, 96
SLACK = 1e-6


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as float64 (exact to 2 ** 53)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


@dataclass
class Node:
    """Split points with the square of their norms; children: >= 0 a node, else ~cell."""

    points: np.ndarray
    squares: np.ndarray
    children: list[int]


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    cells: int = 0
    #: Square of the largest norm of all rows.
    top: float = 0.0
    #: (nodes, FAN, FAN): least and largest distance of split point i to the rows below child j.
    least: np.ndarray | None = None
    largest: np.ndarray | None = None

    def distances(self, node: Node, x: np.ndarray, squares: np.ndarray, query: bool) -> np.ndarray:
        """From each x (row or query) to each split point, both lifted."""
        product = x @ node.points.T
        if not query:
            lift = np.sqrt(np.maximum(self.top - squares, 0))
            product += lift[:, None] * np.sqrt(np.maximum(self.top - node.squares, 0))[None, :]
            squares = np.full(len(x), self.top)
        return np.sqrt(np.maximum(squares[:, None] + self.top - 2 * product, 0))

    def descend(self, x: np.ndarray, query: bool = False, seen=None) -> np.ndarray:
        """The cell of each x. `seen(node, distances, child)` is told of every step."""
        out = np.zeros(len(x), np.int64)
        squares = norms(x)
        waiting = [(0, np.arange(len(x)))] if self.nodes else []
        while waiting:
            at, rows = waiting.pop()
            node = self.nodes[at]
            d = self.distances(node, x[rows], squares[rows], query)
            child = d.argmin(axis=1)
            if seen is not None:
                seen(at, d, child)
            for j, below in enumerate(node.children):
                part = rows[child == j]
                if len(part):
                    if below < 0:
                        out[part] = ~below
                    else:
                        waiting.append((below, part))
        return out

    def reached(self, q: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> list[np.ndarray]:
        """The cells of each query that hold rows and that one of its windows of scores may meet.

        lower, upper: (queries, windows); a window with lower > upper is empty.
        """
        squares = norms(q)
        slack = SLACK * (np.sqrt(squares) + np.sqrt(self.top))[:, None]
        reach = squares[:, None] + self.top
        near = np.sqrt(np.maximum(reach - 2 * np.minimum(upper, reach), 0)) - slack
        far = np.where(lower <= -(2.0**62), np.inf, np.sqrt(np.maximum(reach - 2 * lower, 0)) + slack)
        empty = lower > upper
        near, far = np.where(empty, np.inf, near), np.where(empty, -np.inf, far)
        if not self.nodes:
            return [np.zeros(int((~e).any()), np.int64) for e in empty]
        found: list[list[int]] = [[] for _ in q]
        waiting = [(0, np.arange(len(q)))]
        while waiting:
            at, rows = waiting.pop()
            node = self.nodes[at]
            n = len(node.children)
            d = self.distances(node, q[rows], squares[rows], True)[:, :, None]
            low, high = self.least[at, :n, :n][None], self.largest[at, :n, :n][None]
            nearest = np.maximum(np.maximum(d - high, low - d).max(axis=1), 0)
            farthest = (d + high).min(axis=1)
            meets = ((nearest[:, :, None] <= far[rows][:, None, :]) & (farthest[:, :, None] >= near[rows][:, None, :])).any(axis=2)
            meets &= np.isfinite(low[0]).all(axis=0)[None]
            for j, below in enumerate(node.children):
                part = rows[meets[:, j]]
                if below >= 0:
                    if len(part):
                        waiting.append((below, part))
                else:
                    for r in part.tolist():
                        found[r].append(~below)
        return [np.array(sorted(f), np.int64) for f in found]


def _spread(x: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Up to FAN rows far from each other: each the farthest from those before; equal rows once."""
    chosen = [0]
    gap = np.maximum(squares + squares[0] - 2 * (x @ x[0]), 0)
    while len(chosen) < FAN:
        far = int(gap.argmax())
        if gap[far] <= SLACK * (1 + squares[far]):
            break
        chosen.append(far)
        gap = np.minimum(gap, np.maximum(squares + squares[far] - 2 * (x @ x[far]), 0))
    return np.array(chosen)


def grown(sample: np.ndarray, top: float) -> Tree:
    """The tree of split points; ranges are still to be measured."""
    tree = Tree(top=top)
    waiting = [(None, 0, sample)]
    while waiting:
        parent, slot, x = waiting.pop()
        squares = norms(x)
        picked = _spread(x, squares) if len(x) > SMALL else np.zeros(0, np.int64)
        if len(picked) < 2:
            below = ~tree.cells
            tree.cells += 1
        else:
            below = len(tree.nodes)
            node = Node(x[picked], squares[picked], [0] * len(picked))
            tree.nodes.append(node)
            near = tree.distances(node, x, squares, False).argmin(axis=1)
            waiting += [(below, j, x[near == j]) for j in range(len(picked))]
        if parent is not None:
            tree.nodes[parent].children[slot] = below
    return tree


def measured(tree: Tree, batches: Iterator[np.ndarray]) -> Iterator[tuple[int, int, int, float, float]]:
    """(node, split point, child, least, largest distance) over one task's rows."""
    shape = (len(tree.nodes), FAN, FAN)
    least, largest = np.full(shape, np.inf), np.full(shape, -np.inf)

    def seen(at: int, d: np.ndarray, child: np.ndarray) -> None:
        for j in np.unique(child):
            part, n = d[child == j], d.shape[1]
            least[at, :n, j] = np.minimum(least[at, :n, j], part.min(axis=0))
            largest[at, :n, j] = np.maximum(largest[at, :n, j], part.max(axis=0))

    for x in batches:
        tree.descend(x, seen=seen)
    for at, i, j in np.argwhere(np.isfinite(least)).tolist():
        yield at, i, j, float(least[at, i, j]), float(largest[at, i, j])


def with_ranges(tree: Tree, rows: list[tuple[int, int, int, float, float]]) -> Tree:
    """`tree` knowing its ranges; a child below which no row lies is never reached."""
    shape = (len(tree.nodes), FAN, FAN)
    tree.least, tree.largest = np.full(shape, np.inf), np.full(shape, -np.inf)
    for at, i, j, low, high in rows:
        tree.least[at, i, j], tree.largest[at, i, j] = low, high
    return tree
