"""Exact expanding order statistics of long panels, by counts over stretches of time and buckets of values.

``bands.thresholds`` collects the history of each row, which is fine for a value a month. Here a panel may have any length.
While a stretch of rows is added to a panel, the k-th smallest value can only move over as many ranks as rows are added. Counts of
a panel's values by units of time and buckets of values tell which buckets these ranks lie in. So a stretch needs its own rows and
the earlier values of a few buckets, and finds all its percentiles in one task. Every row is shuffled twice, and as candidate about
once, whatever the length of its panel.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, shared_folder

#: Rows of a panel that one task runs through, at least; it grows with the root of the rows, so that counts stay fewer than rows.
STRETCH = 1 << 18
#: Units of time in a stretch: their counts say how far percentiles move inside of it.
UNITS = 16
#: Rows of a table of counts that is broadcast; a longer one is joined by a shuffle.
FEW = 1 << 20


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its columns take a fraction of a checkpoint's bytes."""
    path = f"{shared_folder(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bounded(few: DataFrame) -> tuple[DataFrame, bool]:
    """Counts kept by a checkpoint, with a broadcast hint (and true) if they are few."""
    few = cut(few)
    return (F.broadcast(few), True) if few.limit(FEW + 1).count() <= FEW else (few, False)


def numbered(rows: DataFrame, keys: list[str], order: list[str], at: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their number from 0 in ``order`` within ``keys``, without gathering the rows of a key in one task.

    Rows are exchanged by ranges (``parts`` of them) and written; a partition's rows are numbered where they lie, from the counts of
    the partitions before it (one row for each partition and key). Of rows that tie, any may come first.
    """
    by = [*keys, *order]
    # Rows that tie are dealt by where they come from.
    tied = rows.select("*", F.spark_partition_id().alias("_tie"))
    ranges = [*by, "_tie"]
    dealt = (tied.repartitionByRange(parts, *ranges) if parts else tied.repartitionByRange(*ranges)).drop("_tie").sortWithinPartitions(*by)
    dealt = _written(dealt.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    starts = dealt.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_ahead", F.coalesce(F.sum("_here").over(before), F.lit(0))).drop("_here")
    starts, few = _bounded(starts.toDF(*[f"_k{n}" for n in range(len(keys))], "_p", "_first", "_ahead"))
    same = F.col("_part") == F.col("_p")
    for n, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_k{n}"))
    found = dealt.join(starts, same).select(*rows.columns, (F.col("_place") - F.col("_first") + F.col("_ahead")).alias(at))
    return found if few else _written(found)


def _buckets(known: DataFrame, count: int) -> Callable[[Column, Column], Column]:
    """The bucket of a value in its numbered panel: ``count`` buckets a panel with about as many values each.

    A value that fills whole buckets gets one of its own, which ``_candidates`` hands on as a count.
    """
    cuts = [float(f) for f in np.arange(1, count) / count]
    held = known.groupBy("_number").agg(F.percentile_approx("_micros", cuts, 4 * count).alias("cuts")) if cuts else known.limit(0).select("_number", F.array("_micros").alias("cuts"))
    ends: dict[int, np.ndarray] = {}
    for row in held.collect():
        found, times = np.unique(np.asarray(row["cuts"], "i8"), return_counts=True)
        ends[row["_number"]] = np.union1d(found, found[times > 1] - 1)
    shared = known.sparkSession.sparkContext.broadcast(ends)

    @F.pandas_udf("int")
    def bucket(number: pd.Series, micros: pd.Series) -> pd.Series:
        panels, values, out = number.to_numpy(), micros.to_numpy(), np.zeros(len(number), "i4")
        for panel in np.unique(panels):
            mine = panels == panel
            out[mine] = np.searchsorted(shared.value.get(int(panel), ()), values[mine])
        return pd.Series(out)

    return bucket


def _candidates(placed: DataFrame, percents: tuple[int, ...], unit: int) -> DataFrame:
    """The earlier values among which each stretch's percentiles can lie: _panel, _stretch, percent, value, count.

    A row stands for ``count`` equal values; the one without a value says how many earlier values are less than all of them.
    Only panels of several stretches have candidates.
    """
    panels = placed.groupBy("_panel").agg((F.max("_at") + 1).alias("_rows"), F.count("_micros").alias("_known"))
    panels = cut(panels.where(f"_rows > {unit * UNITS} and _known > 0").withColumn("_number", F.row_number().over(Window.orderBy("_panel")) - 1))
    longest = panels.agg(F.max("_known")).first()[0] or 0
    known = placed.where("_micros is not null").join(F.broadcast(panels.select("_panel", "_number")), "_panel")
    known = known.select("_panel", "_number", "_micros", F.expr(f"_at div {unit}").alias("_unit"))
    bucket = _buckets(known, -(-longest // unit))
    known = known.withColumn("bucket", bucket("_number", "_micros"))

    # How many values each unit of time has in each bucket, those of all earlier units, and those of them in smaller buckets.
    cells = cut(known.groupBy("_number", "_unit", "bucket").agg(F.count(F.lit(1)).alias("here"), F.min("_micros").alias("least"), F.max("_micros").alias("most")))
    buckets = cells.groupBy("_number", "bucket").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    units = panels.select("_number", F.explode(F.sequence(F.lit(0), F.expr(f"(_rows - 1) div {unit}"))).alias("_unit"))
    whole = units.join(buckets, "_number").join(cells.select("_number", "_unit", "bucket", "here"), ["_number", "_unit", "bucket"], "left").na.fill(0, ["here"])
    earlier = Window.partitionBy("_number", "bucket").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("_number", "_unit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("_number", "_unit")
    whole = whole.withColumn("past", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    whole = whole.withColumns({"below": F.coalesce(F.sum("past").over(smaller), F.lit(0)), "refs": F.sum("past").over(everything), "added": F.sum("here").over(everything)})
    whole = cut(whole.withColumn("_stretch", F.expr(f"_unit div {UNITS}")))

    # The k-th of all values is, while ``added`` come, one of the earlier ones from rank k - added on (k of the unit's end) or a new one.
    ends = whole.where("refs > 0 and past > 0").withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    ends = ends.withColumn("k", F.expr("(refs + added - 1) * percent div 100"))
    ends = ends.withColumns({"low": F.expr("least(greatest(k - added - 1, 0), refs - 1)"), "high": F.expr("least(k + 2, refs - 1)")})
    ends = ends.where("below + past > low and below <= high")
    hulls = ends.groupBy("_number", "_stretch", "percent").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    starts = whole.where(f"_unit % {UNITS} = 0 and _unit > 0").select("_number", "_stretch", "bucket", "past", "below", "least", "most")
    asked = cut(starts.join(hulls, ["_number", "_stretch"]).where("bucket between first and last"))
    below = asked.groupBy("_number", "_stretch", "percent").agg(F.lit(None).cast("long").alias("value"), F.min("below").alias("count"))
    alike = asked.where("least = most and past > 0").select("_number", "_stretch", "percent", F.col("least").alias("value"), F.col("past").alias("count"))
    # Few: a stretch asks for about UNITS buckets at most, more only at the beginning of a panel.
    wanted, _ = _bounded(asked.where("least < most and past > 0").groupBy("_number", "bucket").agg(F.collect_list(F.struct("_stretch", "percent")).alias("to")))
    sent = known.join(wanted, ["_number", "bucket"]).select("_number", F.col("_micros").alias("value"), F.expr(f"inline(filter(to, t -> t._stretch > _unit div {UNITS}))"))
    sent = sent.select("_number", "_stretch", "percent", "value", F.lit(1).cast("long").alias("count"))
    found = below.unionByName(alike).unionByName(sent)
    return found.join(F.broadcast(panels.select("_number", "_panel")), "_number").drop("_number")


def _walk(values: np.ndarray, earlier: np.ndarray, below: int, refs: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The two values next to a percentile, after each number of ``values`` (from none to all) has come to ``refs`` earlier ones.

    ``earlier`` are those that can matter, with ``below`` smaller ones. All values are linked in order; they are taken out again from
    the last to the first, so that the place of the percentile moves by a step at most.
    """
    n, every = len(values), np.concatenate([earlier, values])
    order = np.argsort(every, kind="stable")
    place = np.empty(len(every), "i8")
    place[order] = np.arange(1, len(every) + 1)
    come = place[len(earlier) :].tolist()
    after, before = [*range(1, len(every) + 2), len(every) + 1], list(range(-1, len(every) + 1))
    ranks = np.maximum(refs + np.arange(n + 1) - 1, 0) * percent // 100
    falls = np.diff(ranks, prepend=ranks[:1]).astype(bool).tolist()
    lows, highs, p = [0] * (n + 1), [0] * (n + 1), int(ranks[n]) - below + 1
    for j in range(n, 0, -1):
        lows[j], highs[j] = p, after[p]
        x = come[j - 1]
        a, b = before[x], after[x]
        after[a], before[b] = b, a
        if x > p:
            if falls[j]:
                p = before[p]
        elif x < p:
            if not falls[j]:
                p = after[p]
        else:
            p = a if falls[j] else b
    lows[0], highs[0] = p, after[p]
    # Behind the last value stands the last again: nothing is interpolated there.
    line = np.concatenate([every[order][:1], every[order], every[order][-1:]])
    return line[lows], line[highs]


def _stretch_of(columns: list[str], percents: tuple[int, ...], include_current: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a stretch's rows and candidates that adds the number of references and the values next to each percentile."""

    def found(rows: pa.Table, sent: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["_at"].to_numpy(), kind="stable")))
        known = rows["_micros"].is_valid().to_numpy(zero_copy_only=False)
        values = rows["_micros"].drop_null().to_numpy()
        seen = np.cumsum(known) - (0 if include_current else known)
        refs = rows["_refs"][0].as_py() if len(rows) else 0
        out = rows.select(columns).append_column("reference_count", pa.array(refs + seen, pa.int64()))
        percent, value, count = sent["percent"].to_numpy(), sent["value"], sent["count"].to_numpy()
        empty, numbers = np.asarray(value.is_null()), value.fill_null(0).to_numpy()
        for q in percents:
            earlier, below = np.empty(0, "i8"), 0
            if refs:
                below = int(count[(percent == q) & empty][0])
                mine = np.flatnonzero((percent == q) & ~empty)
                mine = mine[np.argsort(numbers[mine], kind="stable")]
                # Only the ranks that can be reached, as one value may stand for very many.
                least, most = max((refs + len(values) - 1) * q // 100 - len(values) - 1, 0), (refs + len(values) - 1) * q // 100 + 2
                ends = below + np.cumsum(count[mine])
                kept = np.minimum(ends, most + 1) - np.maximum(ends - count[mine], least)
                earlier, below = np.repeat(numbers[mine], np.maximum(kept, 0)), max(below, least)
            low, high = _walk(values, earlier, below, refs, q) if refs + len(values) else (np.zeros(1, "i8"),) * 2
            out = out.append_column(f"_low{q}", pa.array(low[seen])).append_column(f"_high{q}", pa.array(high[seen]))
        return out

    return found


def expanding_percentiles(
    rows: DataFrame, keys: list[str], order: list[str], value: str, percents: tuple[int, ...] = (70, 85, 95), include_current: bool = False, stretch: int = STRETCH
) -> DataFrame:
    """Add ``reference_count`` and p<percent>: exact linear percentiles of all values before each row of its panel.

    Values are taken as whole millionths (half to even), as in ``bands``; nulls are rows without a value. Rows of a panel that
    tie in ``order`` come one after another, in any order. Without references, percentiles are null.
    """
    columns, total = rows.columns, rows.count()
    # Units have four roots of the rows at least, so that there are fewer counts than rows.
    unit = max(1, stretch // UNITS, math.isqrt(16 * total) if stretch >= STRETCH else 1)
    stretch = unit * UNITS
    micros = F.bround(F.col(value).cast("decimal(38,8)") * 1_000_000, 0).cast("long")
    # A structure is a key that is never null, so that panels without a name are panels too.
    added = {"_micros": micros, "_panel": F.struct(*keys)}
    placed = numbered(rows, keys, order, "_at", max(1, -(-total // STRETCH))).withColumns(added)

    here = placed.withColumn("_stretch", F.expr(f"_at div {stretch}")).groupBy("_panel", "_stretch").agg(F.count("_micros").alias("_here"))
    before = Window.partitionBy("_panel").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    refs, _ = _bounded(here.select("_panel", "_stretch", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_refs")))
    staged = placed.withColumn("_stretch", F.expr(f"_at div {stretch}")).join(refs, ["_panel", "_stretch"]).select(*columns, "_panel", "_stretch", "_at", "_micros", "_refs")
    group = ["_panel", "_stretch"]
    numbers = [T.StructField(c, T.LongType()) for c in ("reference_count", *(f"_{end}{q}" for q in percents for end in ("low", "high")))]
    schema = T.StructType([*rows.schema.fields, *numbers])
    sent = _candidates(placed, percents, unit)
    found = staged.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(_stretch_of(columns, percents, include_current), schema)
    return found.select(*columns, "reference_count", *[_interpolated(q).alias(f"p{q}") for q in percents])


def _interpolated(percent: int) -> Column:
    """Linear between the two values next to it, on decimals, half to even at six places."""
    n = F.col("reference_count")
    a, b = F.col(f"_low{percent}"), F.col(f"_high{percent}")
    part = ((n - 1) * percent % 100).cast("decimal(3,0)")
    scaled = a.cast("decimal(20,0)") * 100 + (b.cast("decimal(20,0)") - a.cast("decimal(20,0)")) * part
    exact = scaled.cast("decimal(24,0)") * F.lit("0.00000001").cast("decimal(9,8)")
    return F.when(n > 0, F.bround(exact, 6).cast("double"))
