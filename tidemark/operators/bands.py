"""Expanding percentile bands and the two-month dwell, as window functions over frozen months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import classify, exact_percentile, six_places

BURN_IN, MIN_REFERENCES, DWELL = 36, 35, 2


def thresholds(
    rows: DataFrame, keys: list[str], value: str = "value", include_current: bool = False,
    burn_in: int = BURN_IN, minimum: int = MIN_REFERENCES,
) -> DataFrame:
    """Add position, reference_count, eligible, and p70, p85, p95 of the frozen values before each month.

    Values are rounded to six places before they enter the history or are compared. The history of a panel is one value
    a month, so its window is short, and panels (``keys``) spread over tasks.
    """
    order = Window.partitionBy(*keys).orderBy("month_idx")
    frame = order.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    rows = rows.withColumn("frozen", six_places(F.col(value)))
    micros = F.round(F.col("frozen") * 1_000_000).cast("long")
    rows = rows.withColumns(
        {
            "position": F.row_number().over(order),
            "reference_count": F.count("frozen").over(frame).cast("int"),
            "refs": F.array_sort(F.collect_list(micros).over(frame)),
        }
    ).withColumn("eligible", (F.col("position") >= burn_in) & (F.col("reference_count") >= minimum))
    cut = {f"p{q}": F.when(F.col("eligible"), exact_percentile(F.col("refs"), q)) for q in (70, 85, 95)}
    return rows.withColumns(cut).drop("refs")


def raw_band(rows: DataFrame) -> DataFrame:
    """Add the band of each eligible month's value."""
    return rows.withColumn("raw_band", classify(F.col("frozen"), F.col("p70"), F.col("p85"), F.col("p95")))


def dwell(rows: DataFrame, keys: list[str], raw: str = "raw_band", months: int = DWELL) -> DataFrame:
    """Add run, confirmed_band, candidate_band, candidate_count and published_band.

    A band is confirmed by ``months`` equal months in a row; a month without a band breaks a run and keeps what was
    confirmed. In closed form: the length of each run of equal bands, and the last band whose run was long enough.
    """
    order = Window.partitionBy(*keys).orderBy("month_idx")
    changed = ~F.coalesce(F.col(raw) == F.lag(raw).over(order), F.lit(False))
    rows = rows.withColumn("run_id", F.sum(changed.cast("int")).over(order))
    run = F.row_number().over(Window.partitionBy(*keys, "run_id").orderBy("month_idx"))
    rows = rows.withColumn("run", F.when(F.col(raw).isNotNull(), run))
    confirmed = F.last(F.when(F.col("run") >= months, F.col(raw)), ignorenulls=True).over(order)
    rows = rows.withColumn("confirmed_band", confirmed)
    waiting = F.col(raw).isNotNull() & ~F.col(raw).eqNullSafe(F.col("confirmed_band"))
    return rows.withColumns(
        {
            "candidate_band": F.when(waiting, F.col(raw)),
            "candidate_count": F.when(waiting, F.col("run")).otherwise(0).cast("int"),
            "published_band": F.when(F.col(raw).isNotNull(), F.col("confirmed_band")),
        }
    ).drop("run_id")


def chain_issues(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Months that don't follow their predecessor by one, or weren't finalised after it."""
    order = Window.partitionBy(*keys).orderBy("month_idx")
    rows = rows.withColumns(
        {"previous_month": F.lag("month_idx").over(order), "previous_final": F.lag("finalized_on").over(order)}
    )
    code = F.when(F.col("month_idx") != F.col("previous_month") + 1, "month_gap").when(
        F.col("finalized_on") <= F.col("previous_final"), "finalization_order"
    )
    return rows.withColumn("code", code).where("code is not null")
