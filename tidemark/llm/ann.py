"""Nearest neighbours by a block matrix join on int8 codes.

Vectors are rounded to int8 codes with a scale each. The product of two tiles of codes gives the inner products of all
their pairs up to a known error: the norms of what rounding took away. A pair that, at best, stays below the kth best
worst case is dropped; survivors are recomputed in double precision from the original vectors, and heaps keep the best.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import Search, search_blocks
from tidemark.llm.common import col

TILE = 1024


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the rounded vectors, and norms of the rounding errors (rounded up)."""
    scale = np.abs(vectors).max(axis=1, initial=0.0) / 127.0
    scale = np.where(scale > 0, scale, 1.0)  # the smallest of numbers can have a scale of zero; their error says so
    codes = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    rounded = codes * scale[:, None]
    up = 1.0 + 1e-9
    return codes, scale, np.sqrt((rounded**2).sum(axis=1)) * up, np.sqrt(((vectors - rounded) ** 2).sum(axis=1)) * up


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


@dataclass(frozen=True)
class Coded:
    """A block: ids in ascending order, vectors, their codes, scales, and norms of what is rounded and of the rest."""

    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    err: np.ndarray


def coded(ids: np.ndarray, vectors: np.ndarray) -> Coded:
    with np.errstate(over="ignore", invalid="ignore"):
        return Coded(ids, vectors, *quantise(vectors))


def tiles(asking: Coded, base: Coded, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of largest inner product for every query, of those that reach its floor; a query is never its own answer.

    Where a bound isn't a finite number, as with components near the largest double, the pair survives and is computed;
    a product that is no number itself ranks first, as Spark orders it.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _tiles(asking, base, k, floors)


def _tiles(asking: Coded, base: Coded, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Sums of products of codes: whole numbers that the chosen floats hold exactly. Only a tile at a time is a float.
    kind = np.float32 if asking.codes.shape[1] * 127 * 127 < 2**24 else np.float64
    heaps: list[list[tuple[bool, float, int]]] = [[] for _ in asking.ids]  # whether no number, product, row
    worst = floors.copy()
    for a in range(0, len(asking.ids), TILE):
        qs = slice(a, a + TILE)
        codes = asking.codes[qs].astype(kind)
        for b in range(0, len(base.ids), TILE):
            vs = slice(b, b + TILE)
            near = (codes @ base.codes[vs].astype(kind).T).astype(np.float64) * asking.scale[qs, None] * base.scale[None, vs]
            room = asking.norm[qs, None] * base.err[None, vs] + asking.err[qs, None] * (base.norm[None, vs] + base.err[None, vs])
            room *= 1.0 + 1e-9
            own = asking.ids[qs, None] == base.ids[None, vs]
            sure = np.isfinite(near) & np.isfinite(room)
            low = np.where(sure & ~own, near - room, -np.inf)
            floor = worst[qs]
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            left, right = np.nonzero((~sure | (near + room >= floor[:, None])) & ~own)
            exact = inner(asking.vectors[qs][left], base.vectors[vs][right])
            for n, no, s in zip((left + a).tolist(), (right + b).tolist(), exact.tolist()):
                heap, key = heaps[n], (s != s, 0.0 if s != s else s, -no)
                if len(heap) < k:
                    heapq.heappush(heap, key)
                elif key > heap[0]:
                    heapq.heapreplace(heap, key)
            for n in set((left + a).tolist()):
                if len(heaps[n]) == k:
                    worst[n] = max(worst[n], np.inf if heaps[n][0][0] else heaps[n][0][1])
    found = [(n, -no, np.nan if odd else s) for n, heap in enumerate(heaps) for odd, s, no in heap]
    q_no, no, score = zip(*found) if found else ((), (), ())
    return np.array(q_no, np.int64), base.ids[np.array(no, np.int64)], np.array(score, np.float64)


def nearest(
    rows: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    block_rows: int = 8192,
    query_rows: int = 2048,
    counted: dict[str, int] | None = None,
) -> DataFrame:
    """The ``k`` rows of largest inner product for the rows where ``queries`` holds: query_id, rank, vec_id, score.

    The error bounds are safe, so nothing that belongs in a result is lost. Scores are in double precision on the
    original vectors; ties go to smaller ids; a query with fewer than ``k`` other rows has them all. Vectors that are
    null, empty, zero, or hold nulls or non-finite numbers, and rows without an id, take no part; rows that repeat an id
    are one row. An empty table gives an empty result. ``counted`` is given the numbers of pairs of blocks.
    """
    zero = F.forall(col(rows, vector_col), lambda x: x == 0)
    search = Search(lambda v: v, coded, tiles, float)
    return search_blocks(
        rows.where(~F.coalesce(zero, F.lit(False))), id_col, vector_col, queries, k, search, block_rows, query_rows, counted=counted
    )
