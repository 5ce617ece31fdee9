"""Mixing sources to target weights, by fixed-length blocks of words.

The words of each source, document after document, make one stream that is packed into blocks of a fixed length. Every
source gets a target number of words, and so a number of block slots. Output shards have a fixed number of slots; how
many of them each source gets is drawn from a multinomial distribution over what the sources have left, so that the last
shard meets the targets. A slot's number is mapped to a block by a pseudorandom permutation of the source's block numbers
(a fresh one for each pass over the source), and slots are joined to blocks by number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh, small_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Slots that one row stands for before they are exploded, and shards that one row stands for before they are drawn.
PIECE, SHARDS = 4096, 64


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``source_no``, from 1 by code point, nulls last: ranges of sources are sorted and counted on their own."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)  # the parts must not change from here on
    parts = sorted(ranged.groupBy("part").count().collect())  # a row for each partition
    before, ahead = [], 0
    for part, n in parts:
        before.append((part, ahead))
        ahead += n
    known = F.broadcast(ranged.sparkSession.createDataFrame(before, "part int, ahead long"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = F.col("ahead") + F.row_number().over(inside)
    return ranged.join(known, "part").withColumn("source_no", rank.cast("long")).drop("part", "ahead")


def target_words(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Add ``source_no`` and ``target`` to one row per source (weights by the order of ``source``, nulls last, repeating).

    The targets share the sum of all ``size`` by weight. Those above ``cap`` times their source's size stop there, and
    what they leave is shared anew by weight, until none is above. Each round is an aggregate of whole numbers.
    """
    table = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    at = ((F.col("source_no") - 1) % len(weights) + 1).cast("int")
    ranked = cut(numbered(sources).withColumn("weight", F.element_at(table, at)))
    total, stopped, level = ranked.agg(F.sum("size")).first()[0] or 0, -1, 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("size") * F.lit(float(cap)) if stopped >= 0 else F.lit(False)
        n, size, weight = ranked.agg(
            F.count_if(above), F.sum(F.when(above, F.col("size"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == stopped:
            break
        # Once above, always above: the level only rises.
        stopped, level = n, (total - cap * (size or 0)) / weight if weight else float("inf")
    target = F.least(F.col("weight") * F.lit(level), F.col("size") * F.lit(float(cap)))
    return ranked.withColumn("target", target).drop("weight")


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: xor-shifts and multiplications that spread every bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0 .. n-1 takes each x: a Feistel network, walked until the result is below n."""
    x, n = np.asarray(x, np.int64).copy(), np.asarray(n, np.int64)
    key = np.asarray(key, np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    bits += (np.uint64(1) << (np.uint64(2) * bits)) < n.astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    todo = np.arange(len(x))
    rounds = range(3, -1, -1) if inverse else range(4)
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        v = x[todo].astype(np.uint64)
        left, right = v >> b, v & m
        for r in rounds:
            with np.errstate(over="ignore"):
                salt = mix64(k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15))
                if inverse:
                    left, right = right ^ (mix64(left + salt) & m), left
                else:
                    left, right = right, left ^ (mix64(right + salt) & m)
        x[todo] = ((left << b) | right).astype(np.int64)
        todo = todo[x[todo] >= n[todo]]
    return x


def source_key(source: str | None, seed: int, epoch: int) -> int:
    return zlib.crc32((source or "").encode()) ^ (seed << 32) ^ (epoch * 0x5851F42D4C957F2D & (1 << 63) - 1)


def plan_slots(size: int, target: float, block_words: int, key: int) -> tuple[int, int, int]:
    """Blocks of a source, slots that its target fills, and the words of the last slot (the others are full).

    ``key`` is that of the last, partial pass: the one short block may be among its slots.
    """
    want = min(round(target), int(target) + 1)
    if not size or not want:
        return 0, 0, 0
    blocks = -(-size // block_words)
    short = size - (blocks - 1) * block_words
    passes, rest = divmod(want, size)
    if not rest:
        last = int(permute([blocks - 1], [blocks], [source_key_of(key, passes - 1)])[0])
        return blocks, passes * blocks, short if last == blocks - 1 else block_words
    q = int(permute([blocks - 1], [blocks], [source_key_of(key, passes)], inverse=True)[0])
    if rest <= q * block_words:
        k = -(-rest // block_words)
        last = rest - (k - 1) * block_words
    elif rest <= q * block_words + short:
        k, last = q + 1, rest - q * block_words
    else:
        over = rest - q * block_words - short
        k = q + 1 + -(-over // block_words)
        last = over - (-(-over // block_words) - 1) * block_words
    return blocks, passes * blocks + k, last


def source_key_of(base: int, epoch: int) -> int:
    """The permutation's key of a pass over a source."""
    return (base + epoch * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def draw(slots: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` slots each source gets: a multinomial draw by what each has left, none more than it has."""
    got = np.minimum(rng.multinomial(n, slots / slots.sum()), slots)
    while (short := n - int(got.sum())) > 0:
        room = slots - got
        got += np.minimum(rng.multinomial(min(short, int(room.sum())), room / room.sum()), room)
    return got


def shard_counts(slots: np.ndarray, shard_slots: int, seed: int, first: int, until: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slots, numbers of slots) by source, of the shards from ``first`` to ``until``.

    Shards are halved again and again, and what falls to the left half is drawn. A draw depends on its shards and the
    seed alone, so any range of shards can be drawn anywhere, with as many draws as the way to it is long.
    """
    n_shards = -(-int(slots.sum()) // shard_slots)

    def below(low: int, high: int, begin: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if low >= until or high <= first:
            return
        if high - low == 1:
            yield low, begin, left
            return
        mid = (low + high) // 2
        got = draw(left, (mid - low) * shard_slots, np.random.default_rng([seed, low, high]))
        yield from below(low, mid, begin, got)
        yield from below(mid, high, begin + got, left - got)

    yield from below(0, n_shards, np.zeros(len(slots), np.int64), slots.astype(np.int64))


def draw_slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Rows (source_no, shard, slot, block, words): the mix, slot by slot.

    The slots of a source are fixed by its target, so that the mix comes near it at any size; how many of them each
    output shard gets is drawn. The sources' slots are broadcast: a few numbers for each source.
    """
    spark = sources.sparkSession

    @F.pandas_udf("key long, blocks long, slots long, last long")
    def planned(source: pd.Series, size: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = []
        for name, n, t in zip(source, size, target):
            key = source_key(name, seed, 0)
            rows.append((key, *plan_slots(int(n), float(t), block_words, key)))
        return pd.DataFrame(rows, columns=["key", "blocks", "slots", "last"]).astype("int64")

    plans = sources.select("source_no", "size", planned("source", "size", "target").alias("p")).select("source_no", "size", "p.*")
    plans = cut(plans.where("slots > 0"))
    table = plans.select("source_no", "slots").toPandas().sort_values("source_no")
    shared = spark.sparkContext.broadcast((table["source_no"].to_numpy(np.int64), table["slots"].to_numpy(np.int64)))
    n_shards = -(-int(table["slots"].sum()) // shard_slots)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, slots = shared.value
        for batch in batches:
            for at in batch["id"].tolist():
                for shard, begin, count in shard_counts(slots, shard_slots, seed, at, at + SHARDS):
                    some = np.flatnonzero(count)
                    yield pd.DataFrame(
                        {"source_no": numbers[some], "shard": shard, "begin": begin[some], "until": (begin + count)[some]}
                    )

    ranges = spark.range(0, n_shards, SHARDS)
    pieces = ranges.mapInPandas(drawn, "source_no long, shard long, begin long, until long")
    # Long runs of slots are cut before they are exploded, so that a task explodes few at a time.
    starts = F.explode(F.sequence("begin", F.col("until") - 1, F.lit(PIECE))).alias("slot")
    pieces = pieces.select("source_no", "shard", "until", starts).withColumn("until", F.least("until", F.col("slot") + PIECE))

    @F.pandas_udf("long")
    def block_at(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
        n, s = blocks.to_numpy(np.int64), slot.to_numpy(np.int64)
        step = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            keys = key.to_numpy(np.int64).astype(np.uint64) + (s // n).astype(np.uint64) * step
        return pd.Series(permute(s % n, n, keys))

    spread = pieces.repartition("source_no", "shard", "slot").join(F.broadcast(plans), "source_no")
    slots = spread.select(
        "source_no", "size", "key", "shard", "blocks", "slots", "last", F.explode(F.sequence("slot", F.col("until") - 1)).alias("slot")
    )
    slots = slots.withColumn("block", block_at("slot", "blocks", "key"))
    full = F.when(F.col("block") == F.col("blocks") - 1, F.col("size") - F.col("block") * block_words).otherwise(block_words)
    return slots.select(
        "source_no", "shard", "slot", "block",
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).otherwise(full).cast("long").alias("words"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    block_words: int = 256,
    shard_slots: int = 4096,
    seed: int = 17,
    chunk_rows: int = 5_000,
    few_sources: int = 20_000,
    texts: bool = False,
) -> DataFrame:
    """The mix: for every document, what each drawn slot takes from it.

    A row per document and slot: ``row_key`` (names the document's row), the id, ``size`` (words of the document),
    ``source_size``, ``target`` (words, of its source), ``shard``, ``slot``, ``block``, ``from_word`` and ``n_words``;
    with ``texts`` also all other columns of ``docs``, and in ``piece`` the words taken, as they stand in the text.
    Documents of which nothing is taken have one row with nulls and ``n_words`` 0. Texts that are null or without words
    have size 0. A null source is a source, the last one. Repeated rows are documents of their own. An empty table
    gives an empty mix. No document is taken more than ``cap`` times, as a pass takes each block once. Shards have
    ``shard_slots`` slots each, but for the last one.

    Positions in a source's stream are running sums within chunks of about ``chunk_rows`` documents, on top of the sums
    of the chunks before, so a source with a third of all rows is no single task's. Texts are shuffled only on demand.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ident, text, source = col(docs, id_col), col(docs, text_col), col(docs, source_col)
    named = F.xxhash64(F.coalesce(ident.cast("string"), F.lit("null")), text, source)
    sized = cut(
        docs.select(ident.alias("id"), source.alias("source"), named.alias("name"), count_words(text).alias("words"))
    )
    sources = sized.groupBy("source").agg(F.sum("words").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    sources = cut(target_words(sources, weights, cap))
    # One row per source: broadcast after a check of their number; a hot key of the join beyond can be split.
    known = sources.select(F.col("source").alias("its"), "source_no", F.col("size").alias("source_size"), "target", "n_docs")
    known = F.broadcast(known) if sources.limit(few_sources + 1).count() <= few_sources else known.hint("merge")
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("its"))).withColumn(
        "chunk", F.pmod(F.col("name"), F.ceil(F.col("n_docs") / chunk_rows))
    )
    sums = placed.groupBy("source_no", "chunk").agg(F.sum("words").alias("in_chunk"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "chunk", F.coalesce(F.sum("in_chunk").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("name", "id")
    placed = (
        placed.join(sums.hint("merge"), ["source_no", "chunk"])
        .withColumn("nth", F.row_number().over(inside))
        .withColumn("begin", F.col("before") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    )
    length = F.lit(block_words).cast("long")
    touched = F.when(
        F.col("words") > 0,
        F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(begin + words - 1) div {block_words}")),
    ).otherwise(F.array(F.lit(None).cast("long")))
    segments = placed.select(
        "source_no", "chunk", "nth", "id", "name", "words", "source_size", "target", "begin", F.explode(touched).alias("block")
    )
    low = F.greatest(F.col("block") * length, F.col("begin"))
    high = F.least((F.col("block") + 1) * length, F.col("begin") + F.col("words"))
    segments = segments.select(
        "source_no", "block", "id", "name", "words", "source_size", "target",
        F.concat_ws("/", "source_no", "chunk", "nth").alias("row_key"),
        (low - F.col("begin")).alias("from_word"), (low - F.col("block") * length).alias("in_block"), (high - low).alias("there"),
    )
    slots = draw_slots(sources, block_words, shard_slots, seed).select(
        "source_no", "block", "shard", "slot", F.col("words").alias("slot_words")
    )
    # The optimiser can't know how many slots a source explodes to, and must not take them for a small table.
    slots = slots.hint("merge")
    # least() passes over nulls, so segments that no slot takes are told apart first.
    taken = F.when(
        F.col("slot_words").isNotNull(), F.greatest(F.lit(0), F.least(F.col("there"), F.col("slot_words") - F.col("in_block")))
    )
    mixed = segments.join(slots, ["source_no", "block"], "left").select(
        "row_key", "id", "name", F.col("words").alias("size"), "source_size", "target", "shard", "slot", "block",
        "from_word", F.coalesce(taken, F.lit(0)).cast("long").alias("n_words"),
    )
    if not texts:
        return mixed.drop("name").withColumnRenamed("id", id_col)
    return attach(docs, mixed, id_col, text_col, named)


def attach(docs: DataFrame, mixed: DataFrame, id_col: str, text_col: str, named: Column) -> DataFrame:
    """The documents of the mix: one row for each pass over a document, with the words taken in that pass.

    Slots of one pass that take adjoining words of a document are put together again. The columns are those of ``docs``.
    """
    (name,) = fresh(docs, "mix_name")
    # A document's passes are told apart by counting how often a word range has been taken.
    ranges = mixed.where("n_words > 0").withColumn(
        "pass_no", F.row_number().over(Window.partitionBy("row_key", "block").orderBy("slot"))
    )
    runs = ranges.groupBy("row_key", "name", "id", "size", "pass_no").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("runs")
    )
    # Equal rows share a name: each of them would meet the runs of all, so the runs are counted off by rank first.
    rank = Window.partitionBy("name", "id")
    runs = runs.withColumn("nth", F.dense_rank().over(rank.orderBy("row_key")))
    left = docs.withColumn(name, named)
    nth, run_name, run_id, run_nth, run_size, parts = fresh(
        left, "mix_nth", "mix_run_name", "mix_run_id", "mix_run_nth", "mix_run_size", "mix_runs"
    )
    left = left.withColumn(nth, F.row_number().over(Window.partitionBy(F.col(name), col(left, id_col)).orderBy(name)))
    runs = runs.select(
        F.col("name").alias(run_name), F.col("id").alias(run_id), F.col("nth").alias(run_nth), F.col("runs").alias(parts),
        F.col("size").alias(run_size),
    )
    same = (F.col(name) == F.col(run_name)) & col(left, id_col).eqNullSafe(F.col(run_id)) & (F.col(nth) == F.col(run_nth))
    joined = left.join(runs.hint("merge"), same)
    finder = re.compile(WORD)

    @F.pandas_udf("string")
    def piece(text: pd.Series, runs: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for t, rs, n in zip(text, runs, size):
            spans: list[list[int]] = []
            for r in rs:
                a, b = r["from_word"], r["from_word"] + r["n_words"]
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            if spans == [[0, n]]:
                out.append(t)
            else:
                at = [m.span() for m in finder.finditer(t)]
                out.append("\n".join(t[at[a][0] : at[b - 1][1]] for a, b in spans))
        return pd.Series(out, dtype=object)

    return joined.select(
        *[
            piece(col(left, c), F.col(parts), F.col(run_size)).alias(c) if c == text_col else col(left, c)
            for c in docs.columns
        ]
    )
