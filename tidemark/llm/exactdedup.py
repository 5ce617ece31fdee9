"""Exact deduplication by a heavy-hitter split, with DataFrame functions only.

Misra-Gries counters find digests that may be frequent; their exact counts decide which are. The winners are few by
construction, so they are broadcast and their rows are settled where they lie. Only the other digests, none of which
has more than a small share of the rows, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh

#: Summaries are merged in two steps, so that no task gets those of all partitions.
MERGERS = 64


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def frequent(rows: DataFrame, digest_col: str, counters: int) -> DataFrame:
    """(fd_hash): at most ``counters`` hashes, among them those of all digests that clearly more than one row in ``counters`` has.

    Each partition keeps a Misra-Gries summary: a counter for each hash it knows, all lowered alike when there are too
    many (Spark's frequent-items sketch). Summaries merge, here in two steps. The result may hold false positives.
    """
    state = lambda expr: F.expr(expr).alias("fd_state")
    hashed = rows.select(F.xxhash64(col(rows, digest_col)).alias("fd_hash"), F.spark_partition_id().alias("fd_part"))
    local = hashed.groupBy(F.pmod("fd_part", F.lit(MERGERS))).agg(state(f"approx_top_k_accumulate(fd_hash, {counters})"))
    # Grouped, as an empty partition has no summary to merge.
    whole = local.withColumn("fd_all", F.lit(True)).groupBy("fd_all").agg(state(f"approx_top_k_combine(fd_state, {counters})"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(fd_state, {counters})")).alias("fd_item"))
    return found.select(F.col("fd_item.item").alias("fd_hash"))


def mark_duplicates(
    rows: DataFrame,
    id_col: str = "doc_id",
    digest_col: str = "text_sha256",
    keep_col: str = "keep_id",
    size_col: str = "group_size",
    kept_col: str = "kept",
    counters: int = 4096,
) -> DataFrame:
    """Name for every row the row of its group of equal digests that stays: the one with the largest id.

    All columns of ``rows`` come back with ``keep_col`` (the id that stays), ``size_col`` (rows of the group) and
    ``kept_col`` (true for exactly one row of each group); clashing columns are replaced. A null id is smaller than any
    other. Of rows that share the largest id one stays. A null digest is a digest like any other. An empty table gives
    an empty table.

    ``rows`` are checkpointed once, with what is carried along; so give only columns that are wanted. A digest is heavy
    if it has at least one row in ``counters``: there are no more than ``counters`` such digests, which bounds the
    broadcast whatever the input. All other groups are smaller than that share, counted with partial aggregation, and
    joined back by a join that adaptive execution can split; groups of one row don't take part in it.
    """
    names = fresh(rows, "xd_id", "xd_digest", "xd_row", "xd_best", "xd_size", "xd_heavy", "xd_hash")
    ident, digest, row, best, size, heavy, h = names
    keep = [c for c in rows.columns if c.lower() not in (keep_col.lower(), size_col.lower(), kept_col.lower())]
    named = rows.select(
        *[col(rows, c) for c in keep],
        col(rows, id_col).alias(ident),
        F.coalesce(col(rows, digest_col).cast("string"), F.lit("null")).alias(digest),
        F.monotonically_increasing_id().alias(row),
    )
    named = cut(named)
    total = named.count()
    count, last = F.count(F.lit(1)).alias(size), F.max(F.struct(ident, row)).alias(best)

    asked = frequent(named, digest, counters).withColumnRenamed("fd_hash", h)
    asked = cut(asked)
    suspects = named.join(F.broadcast(asked), F.xxhash64(digest) == F.col(h), "left_semi")
    # Exact counts verify the candidates: one row for each digest and task is shuffled.
    winners = suspects.groupBy(digest).agg(count, last).where(F.col(size) * counters >= F.lit(total)).withColumn(heavy, F.lit(True))
    winners = cut(winners)

    split = named.join(F.broadcast(winners), digest, "left")
    settled = split.where(F.col(heavy)).drop(heavy)
    light = split.where(F.col(heavy).isNull()).drop(heavy, size, best)
    groups = cut(light.groupBy(digest).agg(count, last).where(F.col(size) > 1))
    other = light.join(groups.hint("merge"), digest, "left")
    alone = F.col(best).isNull()
    every = settled.unionByName(other)
    return every.select(
        *[col(every, c) for c in keep],
        F.when(alone, F.col(ident)).otherwise(F.col(best)[ident]).alias(keep_col),
        F.coalesce(F.col(size), F.lit(1)).cast("long").alias(size_col),
        (alone | (F.col(best)[row] == F.col(row))).alias(kept_col),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 4096) -> DataFrame:
    """The documents without exact copies: of equal texts (null counts as empty) the row with the largest id stays.

    Columns are those of ``docs``; edge cases are those of ``mark_duplicates``.
    """
    digest, keep, size, kept = fresh(docs, "xd_text", "xd_keep", "xd_size", "xd_kept")
    marked = mark_duplicates(docs.withColumn(digest, text_digest(col(docs, text_col))), id_col, digest, keep, size, kept, counters)
    left = marked.where(F.col(kept))
    return left.select(*[col(left, c) for c in docs.columns])
