"""A Merkle manifest of a dataset, its proofs found by a butterfly exchange.

Leaves are put in order, numbered, and cut into blocks of a power of the fanout, so that a block is a whole subtree. Each
block hashes its own subtree. Then, round by round, the blocks of an aligned group of ``fanout`` swap the subtree roots
that they have reached, and each of them hashes their common ancestor for itself. After the last round every block
knows the root and the siblings of all its ancestors; nothing has to be sent down the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh, small_batches

#: A level of a proof: the digests of the run before and after the node, each run together.
PATH = "array<struct<before:string,after:string>>"
#: Rows up to which a table is broadcast; beyond it is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Rounds of the exchange in one plan, before its lineage is cut.
ROUNDS_A_PLAN = 8


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two rows have one text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if a count shows it to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def number(leaves: DataFrame, tree: str, order: list[str], at: str, total: str) -> DataFrame:
    """``leaves`` with their numbers from 0 in ``order`` within each ``tree``, and how many the tree has.

    One exchange by ranges, kept by a checkpoint; then a partition's rows are numbered where they lie, from the counts
    of the partitions before it (a row for each partition and tree).
    """
    tie, place, part, first, here, ahead = fresh(leaves, "mk_tie", "mk_place", "mk_part", "mk_first", "mk_here", "mk_ahead")
    # Rows that are alike in all columns are told apart by where they come from, so that they don't fall into one task.
    keys = [tree, *order, tie]
    dealt = leaves.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    dealt = cut(dealt).withColumn(place, F.monotonically_increasing_id())
    dealt = dealt.withColumn(part, F.shiftright(place, 33))
    starts = dealt.groupBy(part, tree).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(here))
    every = Window.partitionBy(tree)
    before = every.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumns({ahead: F.coalesce(F.sum(here).over(before), F.lit(0)), total: F.sum(here).over(every)}).drop(here)
    starts = cut(starts)
    found = dealt.join(_small(starts), [part, tree])
    return found.withColumn(at, F.col(place) - F.col(first) + F.col(ahead)).drop(place, part, first, ahead)


def _parents(nodes: list[bytes], fanout: int) -> list[bytes]:
    return [hashlib.sha256(b"".join(nodes[i : i + fanout])).hexdigest().encode() for i in range(0, len(nodes), fanout)]


def _levels(leaves: list[bytes], fanout: int, height: int) -> list[list[bytes]]:
    """All levels of a block's subtree. A block that is its tree's only one has as many as bring it to one node."""
    levels = [leaves]
    while len(levels) <= height if height >= 0 else len(levels[-1]) > 1:
        levels.append(_parents(levels[-1], fanout))
    return levels


def _height(alone: bool, block_height: int) -> int:
    return -1 if alone else block_height


def _path(levels: list[list[bytes]], at: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after a leaf, and after its ancestors, in their runs."""
    path = []
    for level in levels[:-1]:
        low = at - at % fanout
        path.append((b"".join(level[low:at]), b"".join(level[at + 1 : low + fanout])))
        at //= fanout
    return path


def block_roots(blocks: DataFrame, fanout: int, block_height: int) -> DataFrame:
    """(mk_tree, mk_block, mk_blocks, mk_node): the root of each block's subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for digests, many in zip(batch["mk_digests"].to_pylist(), batch["mk_blocks"].to_pylist()):
                tops.append(_levels([d.encode() for d in digests], fanout, _height(many == 1, block_height))[-1][0].decode())
            columns = [batch["mk_tree"], batch["mk_block"], batch["mk_blocks"], pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["mk_tree", "mk_block", "mk_blocks", "mk_node"])

    given = blocks.select("mk_tree", "mk_block", "mk_blocks", F.col("mk_leaves.mk_leaf").alias("mk_digests"))
    return given.mapInArrow(run, "mk_tree string, mk_block long, mk_blocks long, mk_node string")


def butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """(mk_tree, mk_block, mk_node, mk_path): each block's tree root, and the siblings of its ancestors, lowest first.

    In round r the blocks whose numbers differ in digit r alone (in base ``fanout``) form a group and swap their nodes:
    a group has ``fanout`` rows, whatever the tree. A tree's blocks are filled up to a power of the fanout with empty
    ones, at most ``fanout`` times as many; they take part in the rounds, so that the nodes of a ragged edge reach all who need
    them without any block being asked by many.
    """
    most = roots.agg(F.max("mk_blocks")).first()[0] or 0
    whole, rounds = 1, 0
    while whole < most:
        whole, rounds = whole * fanout, rounds + 1
    # Each tree's own power: the least of all powers that reaches its number of blocks.
    powers = F.array(*[F.lit(fanout**r).cast("long") for r in range(rounds + 1)])
    full = F.array_min(F.filter(powers, lambda w: w >= F.col("mk_blocks")))
    chunk = 4096
    edge = roots.where(F.col("mk_block") == F.col("mk_blocks") - 1).where(full > F.col("mk_blocks"))
    # Empty blocks are made in two steps, so that no row holds a long array.
    spans = edge.withColumn("mk_from", F.explode(F.sequence(F.col("mk_blocks"), full - 1, F.lit(chunk).cast("long"))))
    empty = spans.withColumn("mk_block", F.explode(F.sequence("mk_from", F.least(F.col("mk_from") + chunk, full) - 1)))
    state = roots.unionByName(empty.drop("mk_from").withColumn("mk_node", F.lit(None).cast("string")))
    state = state.withColumn("mk_path", F.array().cast(PATH))
    for r in range(rounds):
        low = fanout**r
        # Trees that have come to their root rest: their blocks stay alone in groups of their own.
        rests = F.col("mk_blocks") <= low
        digit = F.when(rests, 0).otherwise(F.expr(f"mk_block div {low}") % fanout).alias("mk_digit")
        group = F.when(rests, F.col("mk_block")).otherwise(F.expr(f"mk_block div {low * fanout}")).alias("mk_high")
        lower = F.when(rests, -1).otherwise(F.col("mk_block") % low).alias("mk_low")
        keyed = state.select("*", digit, group, lower, rests.alias("mk_rests"))
        swapped = keyed.groupBy("mk_tree", "mk_high", "mk_low", "mk_rests", "mk_blocks").agg(
            F.sort_array(F.collect_list(F.struct("mk_digit", "mk_block", "mk_node", "mk_path"))).alias("mk_group")
        )
        joined = lambda keep: F.array_join(F.transform(F.filter("mk_group", keep), lambda m: m["mk_node"]), "")
        run = joined(lambda m: m["mk_node"].isNotNull())
        swapped = swapped.withColumns({"mk_run": run, "mk_me": F.explode("mk_group")})
        mine = F.col("mk_me")["mk_digit"]
        step = F.struct(
            joined(lambda m: m["mk_node"].isNotNull() & (m["mk_digit"] < mine)).alias("before"),
            joined(lambda m: m["mk_node"].isNotNull() & (m["mk_digit"] > mine)).alias("after"),
        )
        parent = F.when(F.col("mk_run") != "", F.sha2(F.col("mk_run").cast("binary"), 256))
        state = swapped.select(
            "mk_tree",
            F.col("mk_me")["mk_block"].alias("mk_block"),
            "mk_blocks",
            F.when(F.col("mk_rests"), F.col("mk_me")["mk_node"]).otherwise(parent).alias("mk_node"),
            F.when(F.col("mk_rests"), F.col("mk_me")["mk_path"]).otherwise(F.concat(F.col("mk_me")["mk_path"], F.array(step))).alias("mk_path"),
        )
        if (r + 1) % ROUNDS_A_PLAN == 0:
            state = cut(state)
    return state.where(F.col("mk_block") < F.col("mk_blocks")).drop("mk_blocks")


def _fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and the siblings of its ancestors give."""
    for before, after in path:
        node = hashlib.sha256(before + node + after).hexdigest().encode()
    return node


def _proofs(fanout: int, block_height: int, carried: list[str], schema: pa.Schema):
    """For batches of blocks: a row for each leaf, its proof hashed and its claimed leaf folded to a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = block["mk_leaves"]
                levels = _levels([r["mk_leaf"].encode() for r in rows], fanout, _height(block["mk_blocks"] == 1, block_height))
                above = [(s["before"].encode(), s["after"].encode()) for s in block["mk_path"]]
                upper = b"".join([x for pair in above for x in pair])
                folded: dict[bytes, bytes] = {}
                out: dict[str, list] = {c: [r[c] for r in rows] for c in carried}
                out |= {"mk_subroot": [block["mk_subroot"]] * len(rows), "mk_root": [block["mk_root"]] * len(rows), "mk_proof": [], "mk_folded": []}
                for n, r in enumerate(rows):
                    path = _path(levels, n, fanout)
                    out["mk_proof"].append(hashlib.sha256(b"".join([x for pair in path for x in pair]) + upper).hexdigest())
                    top = _fold(r["mk_claim"].encode(), path)
                    if top not in folded:  # untampered leaves of a block have its subtree's root in common
                        folded[top] = _fold(top, above)
                    out["mk_folded"].append(folded[top].decode())
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def manifest(
    leaves: DataFrame,
    tree_col: str,
    id_col: str,
    leaf_col: str,
    claim_col: str | None = None,
    fanout: int = 2,
    block_height: int = 10,
) -> DataFrame:
    """The proof of each leaf in a tree of trees: one for each value of ``tree_col``, and one over their roots.

    Within a tree, leaves ascend by ``id_col`` (nulls first; equal ids by their digests; rows alike in both take either place).
    As long as there is more than one node, every ``fanout`` consecutive ones become the hash of their joined hex
    digests; the last run may have fewer, even one. Tree values are ordered by their UTF-8 bytes, null first, and the
    trees' roots become the root in the same way. A tree of one leaf has this leaf as its root.

    ``leaf_col`` has hex digests. Returned are ``id_col``, ``leaf_col``, ``subroot``, ``root``, ``proof_sha256`` (the hash of
    the siblings from the leaf up, each run from left to right), ``folded_root`` (what ``claim_col``, the digest of a row as
    it is now, and these siblings give: without a claim the leaf itself) and ``verified``. An empty table gives none.

    Blocks have fanout ** block_height leaves, so a task's work is bounded however large a tree is. Rows of about 200 bytes a
    leaf are exchanged twice, blocks' roots once a round.
    """
    spark = leaves.sparkSession
    small_batches(spark)
    claim = col(leaves, claim_col or leaf_col)
    key = F.coalesce(F.concat(F.lit("="), col(leaves, tree_col).cast("string")), F.lit(""))  # null first, no value like it
    rows = leaves.select(key.alias("mk_tree"), col(leaves, id_col).alias("mk_id"), col(leaves, leaf_col).alias("mk_leaf"), claim.alias("mk_claim"))
    blocks = _blocks(rows, fanout, block_height)
    found = cut(butterfly(cut(block_roots(blocks, fanout, block_height)), fanout))

    subroots = found.where("mk_block = 0").select(F.lit("").alias("mk_tree"), F.col("mk_tree").alias("mk_id"), F.col("mk_node").alias("mk_leaf"))
    tops = _blocks(subroots.withColumn("mk_claim", F.lit(None).cast("string")), fanout, block_height)
    above = butterfly(cut(block_roots(tops, fanout, block_height)), fanout).withColumnsRenamed({"mk_node": "mk_root", "mk_path": "mk_over"})
    upper = _within(tops.join(above, ["mk_tree", "mk_block"]), fanout, block_height)

    upper = cut(upper)
    known = found.withColumnRenamed("mk_node", "mk_subroot").join(_small(upper), "mk_tree")
    known = cut(known.withColumn("mk_path", F.concat("mk_path", "mk_over")).drop("mk_over"))
    joined = blocks.join(_small(known), ["mk_tree", "mk_block"])
    kept = blocks.schema["mk_leaves"].dataType.elementType
    kind = kept["mk_id"].dataType.simpleString()
    made = "mk_subroot string, mk_root string, mk_proof string, mk_folded string"
    schema = pa.schema(
        [pa.field("mk_id", _arrow(kept["mk_id"].dataType)), pa.field("mk_leaf", pa.string())]
        + [pa.field(c.split()[0], pa.string()) for c in made.split(", ")]
    )
    out = joined.mapInArrow(_proofs(fanout, block_height, ["mk_id", "mk_leaf"], schema), f"mk_id {kind}, mk_leaf string, {made}")
    return out.select(
        F.col("mk_id").alias(id_col),
        F.col("mk_leaf").alias(leaf_col),
        F.col("mk_subroot").alias("subroot"),
        F.col("mk_root").alias("root"),
        F.col("mk_proof").alias("proof_sha256"),
        F.col("mk_folded").alias("folded_root"),
        (F.col("mk_folded") == F.col("mk_root")).alias("verified"),
    )


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _blocks(rows: DataFrame, fanout: int, block_height: int) -> DataFrame:
    """(mk_tree, mk_block, mk_blocks, mk_leaves): the leaves of each block in order; kept by a checkpoint."""
    size = fanout**block_height
    numbered = number(rows, "mk_tree", ["mk_id", "mk_leaf"], "mk_at", "mk_total")
    grouped = numbered.groupBy(
        "mk_tree", F.expr(f"mk_at div {size}").alias("mk_block"), F.expr(f"(mk_total + {size - 1}) div {size}").alias("mk_blocks")
    )
    leaf = F.struct("mk_at", "mk_id", "mk_leaf", "mk_claim")
    return cut(grouped.agg(F.sort_array(F.collect_list(leaf)).alias("mk_leaves")))


def _within(blocks: DataFrame, fanout: int, block_height: int) -> DataFrame:
    """(mk_tree, mk_over, mk_root) for each tree of the blocks' leaves: its whole path to the root over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = block["mk_leaves"]
                levels = _levels([r["mk_leaf"].encode() for r in rows], fanout, _height(block["mk_blocks"] == 1, block_height))
                text = lambda pair: {"before": pair[0].decode(), "after": pair[1].decode()}
                paths = [[*map(text, _path(levels, n, fanout)), *block["mk_over"]] for n in range(len(rows))]
                step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["mk_id"] for r in rows], pa.string()), pa.array(paths, step), pa.array([block["mk_root"]] * len(rows), pa.string())],
                    names=["mk_tree", "mk_over", "mk_root"],
                )

    return blocks.mapInArrow(run, f"mk_tree string, mk_over {PATH}, mk_root string")
