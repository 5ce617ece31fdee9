"""Runs of periodic words, found by uniting suffix classes in the order of descending common prefixes.

Two suffixes of a text belong to one class at length t if their first t words agree. As t falls, classes merge as in
Kruskal's algorithm: union-find over the sorted positions of each class, the smaller set put into the larger one. When a
merge makes positions i < j neighbours in their class, and j - i <= t, the words from i to j + t repeat with period
j - i. Their period can't be smaller (a smaller one would have put a position between them), nor can they go on to the
right (t is all that the two have in common). If the words before i and j differ as well, this is a run, and each run is
met once: at the merge of its first two periods.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import col, small_batches

Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_prefix(min_length: int, min_periods: int) -> int:
    """The least common prefix that two suffixes one period apart have in a run of this length and so many periods."""
    return min(max(min_length - p, (min_periods - 1) * p, 1) for p in range(1, max(min_length, 1) + 1))


def _repeated(ids: np.ndarray, text: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Positions whose first ``width`` words, all of one text, may occur in it again: by hashes, so some too many."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = text[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.flatnonzero(left[:n] >= width)
    order = whole[np.argsort(mixed[whole], kind="stable")]
    same = mixed[order[1:]] == mixed[order[:-1]]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return np.sort(order[hit])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin a new group."""
    new = np.ones(len(keys[0]), bool)
    for key in keys:
        new[1:] &= key[1:] == key[:-1]
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def _edges(ids: np.ndarray, text: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, t): suffixes that follow each other in the order of their words, with t >= width words in common.

    Only the ``asked`` suffixes can have a partner; what stands ``width`` words after them is ranked with them, so that
    prefixes can be doubled. A rank is the place of a group's first suffix, so groups that split keep their order.
    """
    at = np.union1d(asked, asked + width)
    order = np.lexsort([*[ids[at + k] for k in reversed(range(width))], text[at]])
    at = at[order]  # in the order of their first words; suffixes are named by their place in this array from here on
    place = np.full(len(ids) + 1, -1, np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    first = _starts(text[at], *[ids[at + k] for k in range(width)])
    sizes = np.diff(np.append(first, len(at)))
    rank = np.repeat(first, sizes).astype(np.int32)
    sorted_at, levels, depth = np.arange(len(at), dtype=np.int32), [rank.copy()], width
    grouped = np.repeat(sizes > 1, sizes)
    live, together = np.flatnonzero(grouped), rank.copy()
    while len(live):
        behind = rank[place[at[live] + depth]]
        by = np.lexsort((behind, rank[live]))
        live, behind = live[by], behind[by]
        old = rank[live]
        group, part = _starts(old), _starts(old, behind)
        slot = old + np.arange(len(live)) - np.repeat(group, np.diff(np.append(group, len(live))))
        count = np.diff(np.append(part, len(live)))
        sorted_at[slot] = live
        rank[live] = np.repeat(slot[part], count)
        levels.append(rank.copy())
        live, depth = live[np.repeat(count > 1, count)], depth * 2
    # Neighbours in the final order that share their first words; how many more they share is found from long to short.
    i, j = at[sorted_at[:-1]], at[sorted_at[1:]]
    paired = together[sorted_at[:-1]] == together[sorted_at[1:]]
    i, j = i[paired], j[paired]
    common = np.zeros(len(i), np.int64)
    for level in reversed(levels):
        depth //= 2 if level is not levels[-1] else 1
        same = level[place[i + common]] == level[place[j + common]]
        common[same] += depth
    going = np.ones(len(i), bool)
    for _ in range(width - 1):
        going &= ids[i + common] == ids[j + common]
        common[going] += 1
    return i, j, common


def _unite(ids: list[int], edges: Iterator[Run], min_length: int, min_periods: int) -> list[Run]:
    """Runs (first position, length, period), from edges (i, j, t) of descending t."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found: list[Run] = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def seed(x: int, y: int, t: int) -> None:
        period = y - x
        if t >= (min_periods - 1) * period and t + period >= min_length and ids[x - 1] != ids[y - 1]:
            found.append((x, t + period, period))

    for i, j, t in edges:
        a, b = root(i), root(j)
        large, small = members.get(a) or [a], members.get(b) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        members.pop(b, None)
        if 8 * len(small) < len(large):
            ahead = None  # the element of the small set that went in last
            for n, x in enumerate(small):
                k = bisect_left(large, x)
                if k and large[k - 1] != ahead:
                    seed(large[k - 1], x, t)
                if k < len(large) and (n + 1 == len(small) or large[k] < small[n + 1]):
                    seed(x, large[k], t)
                large.insert(k, x)
                ahead = x
        else:
            fresh_ones = set(small)
            large = sorted(large + small)
            for x, y in zip(large, large[1:]):
                if y - x <= t and (x in fresh_ones) != (y in fresh_ones):
                    seed(x, y, t)
        members[a] = large
    return found


def runs_of(texts: list[list[bytes]], min_length: int = 6, min_periods: int = 4) -> list[list[Run]]:
    """The runs (start, length, smallest period) of each text's words, by start and period.

    A run is a stretch that repeats with its period at least ``min_periods`` times (2 or more), has at least ``min_length``
    words, and can't be extended. Texts are worked on together; none of their positions ever meet.
    """
    if min_periods < 2:
        raise ValueError("a run has at least two periods")
    width = least_prefix(min_length, min_periods)
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ends, flat = [-1] * width, [-1]  # marks between texts, equal to no word
    begins = []
    for words in texts:
        begins.append(len(flat))
        flat += map(index.__getitem__, words)
        flat += ends
    lengths = np.array([len(w) for w in texts], np.int64)
    ids = np.array(flat + ends, np.int64)
    text = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths + width), [len(texts)] * width]).astype(np.int64)
    stop = np.concatenate([[0], np.repeat(np.array(begins, np.int64) + lengths, lengths + width), [0] * width]).astype(np.int64)
    found: list[list[Run]] = [[] for _ in texts]
    asked = _repeated(ids, text, stop - np.arange(len(ids)), width)
    if len(asked):
        i, j, common = _edges(ids, text, asked, width)
        by = np.argsort(-common, kind="stable")
        edges = zip(i[by].tolist(), j[by].tolist(), common[by].tolist())
        for at, length, period in _unite(flat, edges, min_length, min_periods):
            n = int(text[at])
            found[n].append((at - begins[n], length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def find_runs(
    docs: DataFrame,
    text_col: str = "text",
    min_length: int = 6,
    min_periods: int = 4,
    runs_col: str = "runs",
    collapsed_col: str = "collapsed",
) -> DataFrame:
    """Add the runs of periodic words of every whole text, and the text with each run cut to its first period.

    Words are divided by ASCII white space and numbered from 0. ``runs_col`` has (start, length, period) by start and
    period: all maximal stretches of at least ``min_length`` words with ``min_periods`` periods or more. ``collapsed_col``
    joins the words that stay by one space. Null and empty texts have no runs and collapse to an empty text. Rows are
    independent: nothing is shuffled, repeated rows repeat, an empty table gives an empty one. All columns of ``docs``
    come back, clashing ones replaced. A worker's memory grows with its longest text (or 1 MB of short ones).
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c.lower() not in (runs_col.lower(), collapsed_col.lower())]
    rows = docs.select(*[col(docs, c) for c in keep], col(docs, text_col).cast("string"))
    rows = rows.toDF(*[f"c{n}" for n in range(len(keep) + 1)])  # whatever the names are
    made = T.StructType.fromDDL(f"runs {RUNS}, collapsed string")
    schema = T.StructType([*rows.schema.fields[:-1], *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            words = [(t or "").encode().split() for t in texts.to_pylist()]
            runs = runs_of(words, min_length, min_periods)
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs)]
            named = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
            columns = [*others, pa.array(named, arrow.field("runs").type), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, runs_col, collapsed_col)
