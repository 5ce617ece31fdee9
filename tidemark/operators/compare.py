"""Finding what differs: JSON trees, keyed findings, label counts, latest rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(value, path: str = "") -> Iterator[tuple[str, str, str]]:
    """(JSON pointer, kind, canonical value) of every node of a tree; containers have an empty value."""
    if isinstance(value, dict):
        yield path, "object", ""
        for k, v in value.items():
            yield from flatten(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        yield path, "array", ""
        for n, v in enumerate(value):
            yield from flatten(v, f"{path}/{n}")
    else:
        kind = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}[type(value)]
        yield path, kind, json.dumps(value, ensure_ascii=False)


def flatten_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value) of all nodes of all documents, a map over rows."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text]):
                out += [(k, *node) for node in flatten(json.loads(t))]
            yield pd.DataFrame(out, columns=[key, "path", "kind", "value"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, path string, kind string, value string")


def tree_diff(reference: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Differences of flattened trees: type_mismatch, value_mismatch, missing_in_candidate, unexpected_in_candidate.

    What lies below a node that is missing or of another type isn't reported again.
    """
    a = reference.select(key, "path", F.col("kind").alias("kind_a"), F.col("value").alias("value_a"))
    b = candidate.select(key, "path", F.col("kind").alias("kind_b"), F.col("value").alias("value_b"))
    both = a.join(b, [key, "path"], "full_outer")
    code = (
        F.when(F.col("kind_b").isNull(), "missing_in_candidate")
        .when(F.col("kind_a").isNull(), "unexpected_in_candidate")
        .when(F.col("kind_a") != F.col("kind_b"), "type_mismatch")
        .when(F.col("value_a") != F.col("value_b"), "value_mismatch")
    )
    found = both.withColumn("code", code).where("code is not null")
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    heads = found.where("code <> 'value_mismatch'").select(F.col(key).alias("k"), F.col("path").alias("above"))
    below = found.withColumn("parent", parent)
    # A node is a consequence if its parent differs too: parents are found level by level, as every level is reported.
    kept = below.join(heads, (below[key] == heads["k"]) & (below["parent"] == heads["above"]) & (below["path"] != ""), "left_anti")
    return kept.select(key, "path", "code", "value_a", "value_b")


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that are new, gone, or not equal in every column."""
    columns = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*columns).alias("o"), F.lit(True).alias("in_old"))
    n = new.select(key, F.struct(*columns).alias("n"), F.lit(True).alias("in_new"))
    both = o.join(n, key, "full_outer")
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    )
    return both.withColumn("change", change).where("change is not null").select(key, "change")


def differs(a: Column, b: Column, tolerance: float | None = None) -> Column:
    """Null-safe inequality, exact or within a tolerance."""
    if tolerance is None:
        return ~a.eqNullSafe(b)
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(F.abs(a - b) > tolerance)


def label_counts(rows: DataFrame, label: str, order: DataFrame) -> DataFrame:
    """Rows per label in the order of the label table (label, ord); labels without rows are left out."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(order), label).select("ord", label, "n")
