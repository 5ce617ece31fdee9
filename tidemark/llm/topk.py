"""Exact top-k by inner product with a dual-tree search over cover trees.

Queries and data are both indexed. A node has a centre and a covering radius, so no pair below two nodes scores more
than the centres' product plus what the radii allow. Node pairs that cannot reach the worst kth score of the query
group are pruned; the others are opened, best bound first, down to leaves, which are scored exactly.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from tidemark.llm.blocks import Search, bounds, search_blocks

LEAF = 64
#: A node that needs more children than this to halve its radius has no structure at that scale, and stays a leaf.
MOST_CHILDREN = 256
#: Rows scored at once: the leaves of the best bounds together, before the bounds of the rest are looked at again.
BATCH = 1024


@dataclass
class Node:
    """Rows of a block, around one of them: all within ``radius`` of the centre, and within ``cover`` of it."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    cover: float
    children: list[Node]
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def cover_tree(points: np.ndarray, rows: np.ndarray, cover: float | None = None, leaf: int = LEAF, most: int = MOST_CHILDREN) -> Node:
    """A cover tree: each row is within ``cover`` of its node's centre.

    The centres of a node's children lie more than half of its cover apart, the first of them is the node's own
    (nesting), and each row is within that half of its child's centre (halving). They are chosen farthest first. Levels
    that would have a single child are skipped. ``radius`` is what is really needed.
    """
    centre = points[rows[0]]
    with np.errstate(over="ignore", invalid="ignore"):
        away = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
    radius = float(away.max())
    node = Node(rows, centre, radius, radius if cover is None else cover, [])
    if len(rows) <= leaf or radius == 0.0 or not np.isfinite(radius):
        return node
    half = node.cover / 2
    while half >= radius:
        half /= 2
    node.cover = 2 * half
    nearest, owner, n = away, np.zeros(len(rows), np.int64), 1
    while nearest.max() > half:
        if n == most:
            return node
        to_far = np.sqrt(((points[rows] - points[rows[int(nearest.argmax())]]) ** 2).sum(axis=1))
        # The new centre is at no distance, so it comes first among its rows.
        owner[to_far < nearest] = n
        nearest = np.minimum(nearest, to_far)
        n += 1
    for c in range(n):
        mine = np.flatnonzero(owner == c)
        first = mine[nearest[mine].argmin()]
        node.children.append(cover_tree(points, rows[np.r_[first, mine[mine != first]]], half, leaf, most))
    node.centres = np.array([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    return node


def _bounds(q: Node, p: Node) -> np.ndarray:
    """The most that any pair below q and each child of p can score, with room for rounding."""
    return bounds(q.centre[None, :], np.array([q.radius]), p.centres, p.radii)[0]


class _Best:
    """The best k of each query so far, as keys that order by score and then by smaller row number."""

    def __init__(self, n_rows: int, k: int, kind, floors: np.ndarray) -> None:
        self.k, self.shift = k, max(1, n_rows - 1).bit_length() if kind is not object else max(1, n_rows).bit_length()
        self.low = -(1 << 62) if kind is not object else -(1 << 3000)
        self.keys = np.full((len(floors), k), self.low, dtype=kind)
        self.worst = floors.copy()

    def add(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        last = (1 << self.shift) - 1
        keys = scores * (1 << self.shift) + (last - rows)[None, :]
        keys[own] = self.low
        both = np.concatenate([self.keys[queries], keys], axis=1)
        both.partition(both.shape[1] - self.k, axis=1)
        self.keys[queries] = both[:, -self.k :]
        kth = self.keys[queries].min(axis=1)
        now = [_float(x >> self.shift) if x != self.low else -np.inf for x in kth.tolist()]
        self.worst[queries] = np.maximum(self.worst[queries], now)


def _float(x: int) -> float:
    """The nearest double, and infinity beyond all of them."""
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def whole(x: float) -> int:
    """floor(64 * x), exactly, also where 64 * x is no double any more."""
    return math.floor(64 * x) if abs(x) < 2.0**60 else 64 * int(x)


@dataclass(frozen=True)
class Indexed:
    """A block: ids in ascending order, vectors as they are and as floor(64 x), and a cover tree over those."""

    ids: np.ndarray
    vectors: np.ndarray
    points: np.ndarray
    tree: Node


def indexed(ids: np.ndarray, vectors: np.ndarray) -> Indexed:
    points = scaled(vectors)
    return Indexed(ids, vectors, points, cover_tree(points, np.arange(len(ids))))


def scaled(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(64 * vectors)


def dual_tree(asking: Indexed, base: Indexed, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query, of those that reach its floor; a query is never its own answer."""
    q, vectors, q_ids, ids = asking.points, base.points, asking.ids, base.ids
    most = float(max(np.abs(q).max(), np.abs(vectors).max()))
    # Doubles hold such products exactly; beyond, Python's integers do.
    exact = most < 2**53 and most * most * q.shape[1] * (len(ids) + 1) < 2**53
    kind = np.int64 if exact else object
    integers = lambda a: np.array([[whole(x) for x in r] for r in a.tolist()], object)
    exact_q, exact_v = (q, vectors) if exact else (integers(asking.vectors), integers(base.vectors))
    best = _Best(len(ids), k, kind, floors)
    data = base.tree

    def score(queries: np.ndarray, found: np.ndarray) -> None:
        scores = exact_q[queries] @ exact_v[found].T
        best.add(queries, found, scores.astype(kind), q_ids[queries][:, None] == ids[found][None, :])

    def visit(node: Node, frontier: list[tuple[float, Node]]) -> None:
        """Score what the queries below ``node`` need, from data nodes with bounds that hold for all of them."""
        if node.children:
            # Open the widest data nodes once for all query children, and drop those no query can use any more.
            opened: list[tuple[float, Node]] = []
            worst = best.worst[node.rows].min()
            for bound, p in frontier:
                if bound < worst:
                    continue
                if p.children and p.radius > node.radius:
                    opened += [(b, c) for b, c in zip(_bounds(node, p).tolist(), p.children) if b >= worst]
                else:
                    opened.append((bound, p))
            for child in node.children:
                visit(child, opened)
            return
        queue, n = [], 0
        for _, p in frontier:
            top = float(bounds(node.centre[None, :], np.array([node.radius]), p.centre[None, :], np.array([p.radius]))[0, 0])
            queue.append((-top, n, p))
            n += 1
        heapq.heapify(queue)
        batch: list[np.ndarray] = []
        gathered, worst = 0, best.worst[node.rows].min()
        while queue or batch:
            if batch and (gathered >= BATCH or not queue or -queue[0][0] < worst):
                score(node.rows, np.sort(np.concatenate(batch)))
                batch, gathered, worst = [], 0, best.worst[node.rows].min()
                continue
            bound, _, p = heapq.heappop(queue)
            if -bound < worst:
                break
            if not p.children:
                batch.append(p.rows)
                gathered += len(p.rows)
                continue
            for b, c in zip(_bounds(node, p).tolist(), p.children):
                if b >= worst:
                    n += 1
                    heapq.heappush(queue, (-b, n, c))

    visit(asking.tree, [(np.inf, data)])
    real = best.keys != best.low
    q_no, _ = np.nonzero(real)
    keys = best.keys[real]
    last = (1 << best.shift) - 1
    found = np.array([last - (int(x) & last) for x in keys], np.int64)
    scores = np.array([min(max(int(x) >> best.shift, -(1 << 63)), (1 << 63) - 1) for x in keys], np.int64)
    return q_no, ids[found], scores


def top_k(
    rows: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    block_rows: int = 8192,
    query_rows: int = 2048,
    counted: dict[str, int] | None = None,
) -> DataFrame:
    """Exact top-k of the rows for which ``queries`` holds, against all other rows, by integer inner product.

    Components become floor(64 * x). Returns query_id, rank (from 1), vec_id and score, ties to smaller ids; a query
    with fewer than ``k`` other rows has them all. Vectors that are null, empty, or hold nulls or non-finite numbers,
    and rows without an id, take no part; rows that repeat an id are one row. An empty table gives an empty result.
    Only columns named here are read. Products beyond 64 bits are compared exactly within two blocks, and reported (and
    ranked between blocks) as the nearest long. ``counted`` is given the numbers of pairs of blocks.
    """
    search = Search(scaled, indexed, dual_tree, int)
    return search_blocks(rows, id_col, vector_col, queries, k, search, block_rows, query_rows, counted=counted)
