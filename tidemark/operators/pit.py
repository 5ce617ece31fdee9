"""Bitemporal operators: as-of selection, span building, coverage guards and keyed upserts.

Spans have series_id, observation_date, realtime_start, realtime_end (inclusive) and value_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import month_of

FOREVER = "9999-12-31"
KEY = ("series_id", "observation_date", "realtime_start")


def as_of(spans: DataFrame, dates: DataFrame, date_col: str = "assembly_date", inclusive_start: bool = True) -> DataFrame:
    """Everything knowable at each date: realtime_start <= date <= realtime_end, for all dates in one plan.

    A stabbing join. Dates are few next to spans, so they get an equi-key of their month; a span is copied to those
    months that it covers and that some date has. That is a hash join whose output is the answer, not all pairs; a span
    that no date stabs costs nothing. What is broadcast is one row, a sorted array of the asked months: as many at most
    as the calendar has. The release date falls back to the start of the span, and the end is capped at the date, so
    that the date of a later revision doesn't leak.
    """
    start, end = F.col("realtime_start"), F.col("realtime_end")
    asked = dates.select(F.col(date_col).alias("as_of_date")).where("as_of_date is not null").distinct()
    asked = asked.withColumn("as_of_month", month_of(F.col("as_of_date")))
    months = asked.agg(F.array_sort(F.collect_set("as_of_month")).alias("asked_months"))
    covered = F.filter("asked_months", lambda m: (m >= month_of(start)) & (m <= month_of(end)))
    spread = (
        spans.where(start <= end)
        .crossJoin(F.broadcast(months))  # one row
        .withColumn("as_of_month", F.explode(covered))
        .drop("asked_months")
    )
    first = start <= F.col("as_of_date") if inclusive_start else start < F.col("as_of_date")
    found = spread.join(asked, "as_of_month").where(first & (F.col("as_of_date") <= end)).drop("as_of_month")
    if "release_date" not in found.columns:
        found = found.withColumn("release_date", F.lit(None).cast("date"))
    return found.withColumns(
        {
            "release_date": F.coalesce("release_date", "realtime_start"),
            "available_from": F.col("realtime_start"),
            "available_through": F.least(F.col("realtime_end"), F.col("as_of_date")),
        }
    ).drop("realtime_start", "realtime_end").withColumnRenamed("as_of_date", date_col)


def latest_version(rows: DataFrame, keys: list[str], order: list[str], eligible: Column | None = None) -> DataFrame:
    """The eligible row that is last in ``order`` for each key, by a partial aggregate instead of a window."""
    if eligible is not None:
        rows = rows.where(eligible)
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*")


def guard_coverage(asked: DataFrame, coverage: DataFrame, date_col: str = "assembly_date") -> DataFrame:
    """Whether each asked (series_id, date) is covered, with a reason where it is not: the guard fails closed."""
    known = coverage.select("series_id", "complete_through")
    joined = asked.join(known, "series_id", "left")
    reason = F.when(F.col("complete_through").isNull(), "no_coverage").when(
        F.col(date_col) > F.col("complete_through"), "beyond_coverage"
    )
    return joined.withColumn("reason", reason).withColumn("covered", F.col("reason").isNull())


def build_spans(rows: DataFrame, coverage: DataFrame, effective: str = "effective_date", order: tuple[str, ...] = ()) -> DataFrame:
    """Close each version the day before the next one; the last one ends with the coverage of its series."""
    window = Window.partitionBy("series_id", "observation_date").orderBy(effective, *order)
    following = F.date_sub(F.lead(effective).over(window), 1)
    return (
        rows.withColumn("next_end", following)
        .join(coverage.select("series_id", "complete_through"), "series_id", "left")
        .withColumn("realtime_start", F.col(effective))
        .withColumn("realtime_end", F.coalesce("next_end", "complete_through"))
        .drop("next_end", "complete_through")
    )


def gaps(rows: DataFrame, frequency: Column) -> DataFrame:
    """Observations that follow their predecessor too late: over a month, a quarter, or eight days."""
    before = F.lag("observation_date").over(Window.partitionBy("series_id").orderBy("observation_date"))
    months = month_of(F.col("observation_date")) - month_of(F.col("previous_date"))
    days = F.datediff("observation_date", "previous_date")
    late = (
        F.when(frequency == "monthly", months > 1).when(frequency == "quarterly", months > 3).otherwise(days > 8)
    )
    return rows.withColumn("previous_date", before).where(F.col("previous_date").isNotNull() & late)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEY, preserve: tuple[str, ...] = ("first_fetched_at", "source", "source_file")) -> DataFrame:
    """``old`` with ``new`` merged in by key; of rows in both, the ``preserve`` columns stay as they were."""
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*columns).alias("o"))
    n = new.select(*keys, F.struct(*[F.col(c) for c in columns]).alias("n"))
    both = o.join(n, list(keys), "full_outer")
    pick = [
        F.when(F.col("o").isNull(), F.col("n")[c])
        .when(F.col("n").isNull() | F.lit(c in preserve), F.col("o")[c])
        .otherwise(F.col("n")[c])
        .alias(c)
        for c in columns
    ]
    return both.select(*keys, *pick)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those distinct rows of ``new`` whose key it doesn't have."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def advance(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """A watermark for each key that never goes back."""
    newer = new.groupBy(key).agg(F.max(mark).alias("newer"))
    return old.join(newer, key, "full_outer").select(key, F.greatest(mark, "newer").alias(mark))


#: Ways in which an availability date can be known.
BASES = ("observed", "umich_unrevised_final")


def snapshot_issues(values: DataFrame, stages: tuple[str, ...] = ("final",), date_col: str = "assembly_date") -> DataFrame:
    """Add ``codes``: the rules that each point-in-time value breaks, in a fixed order.

    ``values`` has the columns of an as-of selection: series_id, asked_series (whose history this is), source,
    known_source (of the registry), observation_date, release_date, available_from, available_through,
    availability_basis, release_stage and retrieved_at (texts, null unless archived). Where a ``provisional`` column says
    so, preliminary stages are allowed besides ``stages``.
    """
    from tidemark.functions.values import utc_timestamp

    keys = Window.partitionBy(date_col, "asked_series")
    day = F.col(date_col)
    archived = F.col("source") == "archive"
    got = utc_timestamp(F.col("retrieved_at"))
    known = F.greatest("release_date", F.to_date(got))
    early = F.col("provisional") & (F.col("release_stage") == "preliminary") if "provisional" in values.columns else F.lit(False)
    rules = {
        "other_series": F.col("series_id") != F.col("asked_series"),
        "other_source": F.col("source") != F.col("known_source"),
        "missing_date": F.col("observation_date").isNull() | F.col("release_date").isNull() | F.col("available_from").isNull() | F.col("available_through").isNull(),
        "repeated_observation": F.count(F.lit(1)).over(Window.partitionBy(date_col, "asked_series", "observation_date")) > 1,
        "released_before_observation": F.col("release_date") < F.col("observation_date"),
        "released_after_assembly": F.col("release_date") > day,
        "available_after_assembly": F.col("available_from") > day,
        "not_available_at_assembly": F.col("available_through") != day,
        "available_before_release": F.col("available_from") < F.col("release_date"),
        "unknown_basis": ~F.col("availability_basis").isin(*BASES),
        "stage_not_allowed": archived & ~F.coalesce(F.col("release_stage").isin(*stages) | early, F.lit(False)),
        "invalid_retrieval": archived & got.isNull(),
        "released_after_retrieval": archived & (F.col("release_date") > F.to_date(got)),
        "wrong_availability": archived
        & (F.col("available_from") != F.when(F.col("availability_basis") == BASES[1], F.col("release_date")).otherwise(known)),
        "empty_history": F.count("observation_date").over(keys) == 0,
    }
    found = [F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]
    return values.withColumn("codes", F.array_compact(F.array(*found)))
