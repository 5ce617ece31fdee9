"""Sharding by histogram sort, with DataFrame functions only.

The sort key of a document is the hash of its text, then the hash of its id. To find the keys at which shards begin, the
exact bytes below candidate boundaries are counted over all partitions; only around the boundaries that are still too
far from their share are new candidates probed. When all splitters meet the tolerance, rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh

#: Bits by which each round refines the candidate boundaries: so a round brings at most 2**BITS rows a splitter.
BITS = 10
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """The first key of a shard: a text hash, and an id hash where a group of equal texts has to be divided."""

    text: int
    ident: int = LOWEST

    def reached(self, text: Column, ident: Column) -> Column:
        if self.ident == LOWEST:
            return text >= self.text
        return (text > self.text) | ((text == self.text) & (ident >= self.ident))


def _probe(
    rows: DataFrame, key: str, shift: int, active: set[int], below: int
) -> tuple[dict[int, int], dict[int, int]]:
    """Exact bytes by candidate interval (key >> shift) inside those still open; the key, where an interval has one."""
    if shift < 64 - BITS:
        rows = rows.where(F.shiftright(F.col(key), below).isin(*active))
    found = (
        rows.groupBy(F.shiftright(F.col(key), shift).alias("at"))
        .agg(F.sum("bytes").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"))
        .collect()
    )
    return {r["at"]: r["bytes"] for r in found}, {r["at"]: r["low"] for r in found if r["low"] == r["high"]}


def _refine(
    rows: DataFrame, key: str, goals: dict[int, tuple[int, int]], tolerance: float
) -> dict[int, tuple[int, int, int]]:
    """For each goal, a boundary of ``key`` with the bytes below it and below the next possible boundary.

    ``goals`` has for each splitter the bytes wanted below it and those below all of ``rows``. A splitter is done as soon
    as one of the candidates is within the tolerance; at the last bit, both neighbours of the goal are exact keys.
    """
    done: dict[int, tuple[int, int, int]] = {}
    left = {n: (None, base) for n, (_, base) in goals.items()}
    shift, below = 64 - BITS, 64
    while left:
        counts, alone = _probe(rows, key, shift, {at for at, _ in left.values()}, below)
        ahead = {}
        for n, (parent, base) in left.items():
            goal, run = goals[n][0], base
            inside = sorted(at for at in counts if parent is None or at >> (below - shift) == parent)
            for at in inside:
                if run + counts[at] >= goal or at == inside[-1]:
                    break
                run += counts[at]
            edges = (at << shift, run, run + counts[at])
            if goal - run <= tolerance:
                done[n] = edges
            elif run + counts[at] - goal <= tolerance:
                done[n] = ((at + 1) << shift, run + counts[at], run + counts[at])
            elif at in alone:
                done[n] = (alone[at], run, run + counts[at])
            else:
                ahead[n] = (at, run)
        left, below = ahead, shift
        shift = max(0, shift - BITS)
    return done


def splitters(rows: DataFrame, n_shards: int, tolerance: float, group_tolerance: float) -> list[Splitter]:
    """The first keys of all shards but the first, for rows with ``text``, ``ident`` (hashes) and ``bytes``."""
    total = rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    if not total:
        return [Splitter((1 << 63) - 1)] * (n_shards - 1)
    share = total / n_shards
    goals = {n: (round(share * n), 0) for n in range(1, n_shards)}
    found: dict[int, Splitter] = {}
    within: dict[int, dict[int, tuple[int, int]]] = {}
    for n, (key, low, high) in _refine(rows, "text", goals, tolerance * share).items():
        goal = goals[n][0]
        if goal - low <= group_tolerance * share:
            found[n] = Splitter(key)
        elif high - goal <= group_tolerance * share:
            found[n] = Splitter(key + 1)
        else:
            within.setdefault(key, {})[n] = (goal, low)
    for key, inner in within.items():  # groups of equal texts too large to stay whole: at most one for each splitter
        group = rows.where(F.col("text") == key)
        for n, (ident, low, high) in _refine(group, "ident", inner, tolerance * share).items():
            goal = inner[n][0]
            nearer = ident if goal - low <= high - goal else ident + 1
            found[n] = Splitter(key, nearer)
    top = (1 << 63) - 1
    return [Splitter(min(found[n].text, top), min(found[n].ident, top)) for n in sorted(found)]


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.001,
    group_tolerance: float = 0.01,
    cell_rows: int = 50_000,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """Deal documents into shards of nearly equal bytes, and number the documents of each shard from 0.

    A document's size is its UTF-8 bytes plus 1 (null and empty texts: 1). Splitters come within ``tolerance`` of a
    shard's share. Equal texts stay in one shard, unless that would move a splitter by more than ``group_tolerance`` of
    the share: only then is the group divided, by the hashes of its ids. All columns come back (clashing ``shard_col``
    and ``slot_col`` are replaced). Null ids are ids like any other. Rows equal in id and text can't be told apart and
    share a shard. With fewer documents than shards, or none, some or all shards stay empty.

    Rounds read a checkpointed projection of 24 bytes a row, and return at most 1,024 counts a splitter. Slots count
    within cells of about ``cell_rows`` rows (key ranges, salted by id where a range holds more) from the exact number
    of rows in the cells before, so no task gets a whole shard, and the rows are exchanged once, by cell.
    """
    text, ident = F.xxhash64(F.coalesce(col(docs, text_col), F.lit(""))), F.xxhash64(col(docs, id_col))
    size = F.octet_length(F.coalesce(col(docs, text_col), F.lit(""))).cast("long") + 1
    rows = cut(docs.select(text.alias("text"), ident.alias("ident"), size.alias("bytes")))
    starts = splitters(rows, n_shards, tolerance, group_tolerance)
    total = rows.count()
    bits = min(14, max(0, (total // cell_rows)).bit_length())

    def place(h: Column, i: Column) -> tuple[Column, Column]:
        shard = F.lit(0)
        for s in starts:
            shard = shard + s.reached(h, i).cast("int")
        return shard, F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long")

    names = fresh(docs, "sh_text", "sh_ident", "sh_cell", "sh_salts", "sh_salt", "sh_from", "sh_no", "sh_rank")
    h, i, cell, salts, salt, first, no, rank = names
    shard_of, cell_of = place(F.col("text"), F.col("ident"))
    placed = rows.select(shard_of.alias(no), cell_of.alias(cell), F.col("ident"))
    # At most 2**14 key ranges and one more for each splitter: a proven bound for the broadcasts below.
    cells = placed.groupBy(no, cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).alias(salts))
    ahead = Window.partitionBy(no).orderBy(cell, salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.join(F.broadcast(cells), [no, cell])
        .groupBy(no, cell, F.pmod(F.col("ident"), F.col(salts)).alias(salt))
        .agg(F.count(F.lit(1)).alias(rank))
        .withColumn(first, F.coalesce(F.sum(rank).over(ahead), F.lit(0)))
        .drop(rank)
    )
    keep = [c for c in docs.columns if c.lower() not in (shard_col.lower(), slot_col.lower())]
    keyed = docs.withColumns({h: text, i: ident})
    shard_of, cell_of = place(F.col(h), F.col(i))
    keyed = keyed.withColumns({no: shard_of, cell: cell_of}).join(F.broadcast(cells), [no, cell])
    keyed = keyed.withColumn(salt, F.pmod(F.col(i), F.col(salts))).join(offsets, [no, cell, salt])
    order = Window.partitionBy(no, cell, salt).orderBy(h, i)
    out = keyed.withColumn(rank, F.row_number().over(order))
    return out.select(
        *[col(out, c) for c in keep],
        F.col(no).alias(shard_col),
        (F.col(first) + F.col(rank) - 1).cast("long").alias(slot_col),
    )
