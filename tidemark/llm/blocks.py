"""Searching all rows for a stated set of queries, block by block.

Similar rows share a block: each goes to its nearest pivot. A block is built once, with whatever index the search wants,
and has a centre, a radius and a norm, so no pair of a query and a row of two blocks scores more than these allow. Each
block of queries first meets the block whose centre is nearest; after that it meets only those blocks whose bound
reaches the worst kth score of its queries. Any first block is right, and the nearest ones differ from query block to query
block, whereas the highest bound may be that of one wide block, or of one with long vectors, for all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, small_batches

#: Blocks whose bounds one task looks at together.
PIECE = 4096
#: Blocks of queries that meet a block in one task; a block that more of them visit is copied.
VISITORS = 64
#: Blocks up to which all are searched at once: a first round would cost more than it saves.
FEW = 4


@dataclass(frozen=True)
class Search:
    """How blocks are made and searched.

    ``points`` gives the vectors whose inner products rank the rows, ``build`` what a block keeps of its ids and vectors,
    ``find`` (query block, block, k, floors) the query index, id and score of the best k of each query, of those that
    reach its floor at least. ``kind`` is the type of a score.
    """

    points: Callable[[np.ndarray], np.ndarray]
    build: Callable[[np.ndarray, np.ndarray], Any]
    find: Callable[[Any, Any, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    kind: type


def usable(vector: Column) -> Column:
    """Vectors that are neither null nor empty, and hold neither nulls nor non-finite numbers."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | F.abs(x.cast("double")).isin(float("inf"))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def bounds(
    q_centre: np.ndarray, q_radius: np.ndarray, centre: np.ndarray, radius: np.ndarray
) -> np.ndarray:
    """The most that any pair within two balls can score, for all pairs of balls; infinite where it is no number."""
    with np.errstate(over="ignore", invalid="ignore"):
        q_norm, norm = np.sqrt((q_centre**2).sum(axis=1))[:, None], np.sqrt((centre**2).sum(axis=1))[None, :]
        room = q_radius[:, None] * norm + radius[None, :] * (q_norm + q_radius[:, None])
        top = q_centre @ centre.T + room + 1e-9 * (q_norm * norm + room) + 1e-300
    return np.where(np.isnan(top), np.inf, top)


def ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """A centre and a radius that hold all points."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9))
    return centre, radius if radius == radius else float("inf")


def _cells(kept: DataFrame, pivots: DataFrame, search: Search) -> DataFrame:
    """Add ``cell``: the number of the nearest of the pivots that have the same length."""
    by_size: dict[int, list] = {}
    for vec in sorted(tuple(r["vec"]) for r in pivots.collect()):
        by_size.setdefault(len(vec), []).append(vec)
    tables = {d: search.points(np.array(v, np.float64)) for d, v in by_size.items()}
    shared = kept.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out, sizes = np.zeros(len(vectors), np.int32), vectors.map(len).to_numpy()
        for d in np.unique(sizes).tolist():
            if d in shared.value:
                at, pivot = np.flatnonzero(sizes == d), shared.value[d]
                x = search.points(np.array(vectors.iloc[at].tolist(), np.float64))
                with np.errstate(over="ignore", invalid="ignore"):
                    away = (pivot**2).sum(axis=1)[None, :] - 2 * x @ pivot.T
                out[at] = np.where(np.isnan(away), np.inf, away).argmin(axis=1)
        return pd.Series(out)

    return kept.withColumn("cell", cell("vec"))


def _built(kept: DataFrame, block_rows: int, query_rows: int, search: Search) -> DataFrame:
    """(kind, block, size, n, centre, radius, packed): blocks (b) of about ``block_rows`` rows, and blocks of queries (q).

    The rows of a block are those of one cell, or of a share of it.
    """
    each = ["id", "vec", "size", "cell"]
    rows = kept.select(*each, F.lit("b").alias("kind")).unionByName(kept.where("asks").select(*each, F.lit("q").alias("kind")))
    n_rows = F.when(F.col("kind") == "b", block_rows).otherwise(query_rows)
    keys = ["kind", "size", "cell"]
    parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.ceil(F.col("n") / n_rows).alias("parts"))
    # Two rows for each pivot and length at most.
    dealt = rows.join(F.broadcast(parts), keys).select(*each, "kind", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids, vectors = frame["id"].to_numpy(np.int64), np.array(frame["vec"].tolist(), np.float64).reshape(len(frame), -1)
        centre, radius = ball(search.points(vectors))
        first = frame.iloc[0]
        name = f"{first['size']}/{first['cell']}/{first['part']}"
        packed = pickle.dumps(search.build(ids, vectors), pickle.HIGHEST_PROTOCOL)
        row = (first["kind"], name, int(first["size"]), len(ids), centre.tobytes(), radius, packed)
        return pd.DataFrame([row], columns=["kind", "block", "size", "n", "centre", "radius", "packed"])

    made = dealt.groupBy("kind", "size", "cell", "part").applyInPandas(
        build, "kind string, block string, size int, n long, centre binary, radius double, packed binary"
    )
    return cut(made)


def _bounded(asking: DataFrame, n_asking: int, base: DataFrame, n_base: int, floors: DataFrame | None) -> DataFrame:
    """(q, b, bound): pairs of blocks of one length, each q with its nearest b only, or all whose bounds reach its floor.

    Blocks are told by their summaries, 4096 against 4096 in a task.
    """
    n_left, n_right = (-(-n // PIECE) or 1 for n in (n_asking, n_base))
    piece = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = asking.select("block", "size", "centre", "radius")
    left = left.join(floors, F.col("block") == F.col("q")).drop("q") if floors is not None else left.withColumn("floor", F.lit(float("-inf")))
    left = left.withColumn("i", piece(n_left))
    right = base.select("block", "size", "centre", "radius").withColumn("j", piece(n_right))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = left.withColumn("j", every(n_right)), right.withColumn("i", every(n_left))
    best_only = floors is None

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "b": [], "bound": []}).astype({"q": object, "b": object, "bound": "float64"})
        b = b.sort_values("block")
        balls = [np.array([np.frombuffer(c) for c in f["centre"]]) for f in (a, b)]
        if best_only:
            with np.errstate(over="ignore", invalid="ignore"):
                top = 2 * balls[0] @ balls[1].T - (balls[1] ** 2).sum(axis=1)[None, :]  # the greatest is the nearest
            top = np.where(np.isnan(top), -np.inf, top)
            at = np.arange(len(a)), top.argmax(axis=1)
        else:
            top = bounds(balls[0], a["radius"].to_numpy(), balls[1], b["radius"].to_numpy())
            at = np.nonzero(top >= a["floor"].to_numpy()[:, None])
        return pd.DataFrame({"q": a["block"].to_numpy()[at[0]], "b": b["block"].to_numpy()[at[1]], "bound": top[at]})

    keys = ["size", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pairs, "q string, b string, bound double")
    if best_only:
        found = found.groupBy("q").agg(F.max_by("b", F.struct("bound", "b")).alias("b"), F.max("bound").alias("bound"))
    return cut(found)


def search_blocks(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    queries: Column,
    k: int,
    search: Search,
    block_rows: int,
    query_rows: int,
    most_pivots: int = 2048,
    counted: dict[str, int] | None = None,
) -> DataFrame:
    """The best ``k`` other rows for each query: (query_id, rank, vec_id, score), best first, ties to smaller ids.

    Pivots are a bounded sample, the first ``most_pivots`` rows at most by a hash of the id: they only say which rows lie
    together. Rows of one pivot are dealt to blocks of about ``block_rows`` by a hash of the id, queries to blocks of
    about ``query_rows``. A task gets one block of each; memory is bounded by the blocks, whatever the number of rows.
    Only vectors of the same length are compared. Rows that repeat an id are one row, that of the smallest vector.
    ``counted`` is given the numbers of pairs of blocks: ``all``, and those ``visited``.
    """
    small_batches(rows.sparkSession)
    kept = rows.select(col(rows, id_col).cast("long").alias("id"), col(rows, vector_col).alias("vec"), queries.alias("asks"))
    kept = kept.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("size", F.size("vec"))
    kept = cut(kept.groupBy("id", "size").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")))
    n_pivots = min(most_pivots, -(-kept.count() // block_rows)) or 1
    kept = _cells(kept, kept.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n_pivots), search)
    built = _built(kept, block_rows, query_rows, search)
    n_blocks = {r["kind"]: r["count"] for r in built.groupBy("kind").count().collect()}
    n_base, n_asking = n_blocks.get("b", 0), n_blocks.get("q", 0)
    # Columns of their own, as both are joined and grouped together.
    base, asking = (built.where(F.col("kind") == k).toDF(*built.columns) for k in ("b", "q"))
    n_parts = max(1, min(n_base, 100_000))
    column = "long" if search.kind is int else "double"
    kind = np.int64 if search.kind is int else np.float64
    data = base.select("block", "packed").withColumnsRenamed({"block": "b", "packed": "b_packed"})
    # The kth score of each query so far; a query with fewer has none yet.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def found(pairs: DataFrame, worst: DataFrame | None) -> DataFrame:
        joined = pairs.select("q", "b").join(asking.select(F.col("block").alias("q"), F.col("packed").alias("q_packed")), "q")
        joined = joined.join(worst.select("q", "worst"), "q") if worst is not None else joined.withColumn("worst", F.lit(None).cast("binary"))
        # A block that very many visit has copies, each for a share of them.
        copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("copies"))
        joined = joined.join(copies.hint("shuffle_hash"), "b").withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")).drop("copies")
        copied = data.join(copies.hint("shuffle_hash"), "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        # A fixed number of partitions, as few bytes may take long: adaptive execution would put them together again.
        copied = copied.repartition(n_parts, "b", "copy")
        joined = copied.join(joined.hint("shuffle_hash"), ["b", "copy"]).select("q", "q_packed", "b_packed", "worst")

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for q, left, right, worst in batch.itertuples(index=False):
                    ids, no, score = _find(search, k, left, right, worst)
                    yield pd.DataFrame({"q": q, "query_id": ids, "vec_id": no, "score": score.astype(kind)})

        return joined.mapInPandas(each, f"q string, query_id long, vec_id long, score {column}")

    if n_base <= FEW:
        same = base.select(F.col("block").alias("b"), F.col("size").alias("b_size"))
        pairs = asking.select(F.col("block").alias("q"), "size").join(same, F.col("size") == F.col("b_size")).select("q", "b")
        if counted is not None:
            counted["all"] = counted["visited"] = pairs.count()
        ranked = found(pairs, None).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    first = _bounded(asking, n_asking, base, n_base, None)
    near = cut(found(first, None))
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", "query_id", "score")
    number = F.nanvl(F.col("score").cast("double"), F.lit(float("inf")))  # what is no number ranks first
    kth = kth.groupBy("q").agg(F.collect_list(F.struct("query_id", number.alias("score"))).alias("kth"))
    sized = asking.select(F.col("block").alias("q"), F.col("n").alias("n_asking"))

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pickle.dumps({r["query_id"]: r["score"] for r in x}) for x in lists], dtype=object)

    floor = F.when(F.size("kth") == F.col("n_asking"), F.array_min(F.transform("kth", lambda x: x["score"])))
    floors = cut(sized.join(kth, "q", "left").select("q", packed("kth").alias("worst"), F.coalesce(floor, F.lit(float("-inf"))).alias("floor")))
    second = _bounded(asking, n_asking, base, n_base, floors.select("q", "floor"))
    second = second.join(first.select("q", F.col("b").alias("done")), "q").where("b <> done").select("q", "b")
    if counted is not None:
        pairs = asking.groupBy("size").count().join(base.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "size")
        counted["all"] = pairs.agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        counted["visited"] = first.count() + second.count()
    every = near.unionByName(found(second, floors)).drop("q")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _find(search: Search, k: int, left: bytes, right: bytes, worst: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of each query of two packed blocks: query ids, ids, scores."""
    asking, base = pickle.loads(left), pickle.loads(right)
    known = pickle.loads(worst) if worst else {}
    floors = np.array([known.get(i, -np.inf) for i in asking.ids.tolist()], np.float64)
    q_no, ids, scores = search.find(asking, base, k, floors)
    return asking.ids[q_no], ids, scores
