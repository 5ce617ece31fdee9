"""Keyed tables as a log of batches that is merged when it is read.

A table is a set of buckets. Each has a base, written by the last compaction, and the batches (deltas) since. Writing a
batch costs what the batch has; nothing that is there is read or written again. A reader scans buckets with one part as
they are, and merges the rows of the others by key: each column by its rule, in the order of the batches. Compaction
writes the buckets anew that have many parts. A table's layout at one moment is an ``Entry``, a small value that the store
keeps in its states.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a column of several rows of one key merges: the newest, the oldest, or the greatest value.
RULES = ("last", "first", "greatest")
#: The number of the batch that a row came with; a base is older than all batches.
SEQ, BUCKET, BASE = "_seq", "_bucket", -1


@dataclass(frozen=True)
class Layout:
    """The shape of a table. Rows of one key share a bucket, as ``spread`` is part of the key."""

    schema: str
    keys: tuple[str, ...]
    rules: dict[str, str] = field(default_factory=dict)
    spread: tuple[str, ...] = ()
    buckets: int = 16

    def __post_init__(self) -> None:
        if not set(self.spread or self.keys) <= set(self.keys):
            raise ValueError("buckets have to go by columns of the key")
        if wrong := {r for r in self.rules.values()} - set(RULES):
            raise ValueError(f"unknown rules: {sorted(wrong)}")

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    @property
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.spread or self.keys)), F.lit(self.buckets)).cast("int")

    def merged(self, rows: DataFrame, seq: str = SEQ) -> DataFrame:
        """One row a key, by partial aggregation."""
        rest = [c for c in self.columns if c not in self.keys]
        by = {rule: [c for c in rest if self.rules.get(c, "last") == rule] for rule in RULES}
        made = []
        if by["last"]:
            made.append(F.max_by(F.struct(*by["last"]), seq).alias("_last"))
        if by["first"]:
            made.append(F.min_by(F.struct(*by["first"]), seq).alias("_first"))
        made += [F.max(c).alias(f"_greatest_{c}") for c in by["greatest"]]
        if not made:
            return rows.select(*self.keys).distinct()
        found = rows.groupBy(*self.keys).agg(*made)
        source = {c: F.col(f"_{rule}.{c}") if rule != "greatest" else F.col(f"_greatest_{c}") for rule in RULES for c in by[rule]}
        return found.select(*[F.col(c) if c in self.keys else source[c].alias(c) for c in self.columns])


@dataclass(frozen=True)
class Entry:
    """Where a table's rows lie at one moment."""

    bases: dict[int, str] = field(default_factory=dict)
    deltas: tuple[tuple[str, tuple[int, ...]], ...] = ()

    @staticmethod
    def of(value: dict | None) -> Entry:
        value = value or {}
        return Entry({int(b): d for b, d in value.get("bases", {}).items()}, tuple((d, tuple(b)) for d, b in value.get("deltas", [])))

    def plain(self) -> dict:
        return {"bases": {str(b): d for b, d in sorted(self.bases.items())}, "deltas": [[d, list(b)] for d, b in self.deltas]}

    def parts(self) -> dict[int, int]:
        """How many parts each bucket has."""
        count: dict[int, int] = defaultdict(int)
        for b in [*self.bases, *[b for _, of in self.deltas for b in of]]:
            count[b] += 1
        return dict(count)

    def folders(self) -> set[str]:
        return {*self.bases.values(), *[d for d, _ in self.deltas]}


class MergeLog:
    """A table under one folder. It keeps no state of its own: entries are given and returned."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout, files: Callable) -> None:
        """``files`` gives (file system, path) of a name under the root."""
        self.spark, self.root, self.layout, self._files = spark, root.rstrip("/"), layout, files

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, tuple[int, ...]]:
        """Rows that know their bucket, a folder a bucket; returns the folder and its buckets, as they are found there."""
        name = f"{kind}-{uuid.uuid4().hex}"
        # Sorted by key, so that readers of one series skip most row groups.
        rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.layout.keys).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}")
        fs, path = self._files(name)
        found = [f.getPath().getName() for f in fs.listStatus(path)]
        return name, tuple(sorted(int(n.partition("=")[2]) for n in found if n.startswith(f"{BUCKET}=")))

    def append(self, entry: Entry, rows: DataFrame, seq: int, order: list[str] | None = None) -> Entry:
        """``entry`` with one more batch. Rows of a key within the batch are merged first, in ``order``."""
        if order:
            rows = self.layout.merged(rows.select(*self.layout.columns, F.struct(*order).alias(SEQ)))
        given = rows.select(*self.layout.columns, self.layout.bucket.alias(BUCKET), F.lit(seq).cast("long").alias(SEQ))
        name, buckets = self._write(given, "delta")
        return Entry(entry.bases, (*entry.deltas, (name, buckets))) if buckets else entry

    def read(self, entry: Entry, buckets: set[int] | None = None) -> DataFrame:
        """The merged rows, of all buckets or of some."""
        count = {b: n for b, n in entry.parts().items() if buckets is None or b in buckets}
        path = lambda folder, b: f"{self.root}/{folder}/{BUCKET}={b}"
        bases = {b: path(d, b) for b, d in entry.bases.items() if b in count}
        deltas = [(b, path(d, b)) for d, of in entry.deltas for b in of if b in count]
        alone = [p for b, p in [*bases.items(), *deltas] if count[b] == 1]
        found = self._scan(alone, self.layout.schema)
        if any(n > 1 for n in count.values()):
            older = self._scan([p for b, p in bases.items() if count[b] > 1], self.layout.schema).withColumn(SEQ, F.lit(BASE).cast("long"))
            newer = self._scan([p for b, p in deltas if count[b] > 1], f"{self.layout.schema}, {SEQ} long")
            found = found.unionByName(self.layout.merged(older.unionByName(newer)))
        return found

    def _scan(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def compact(self, entry: Entry, least: int = 2) -> Entry:
        """``entry`` with each bucket of ``least`` parts or more written as one."""
        full = {b for b, n in entry.parts().items() if n >= least}
        if not full:
            return entry
        name, written = self._write(self.read(entry, full).withColumn(BUCKET, self.layout.bucket), "base")
        bases = {b: d for b, d in entry.bases.items() if b not in full} | {b: name for b in written}
        left = [(d, tuple(b for b in of if b not in full)) for d, of in entry.deltas]
        return Entry(bases, tuple((d, of) for d, of in left if of))
