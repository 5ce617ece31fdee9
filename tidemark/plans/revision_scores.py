"""The composite's unit scores from revisions: values are transformed as spans, then scored by signed changes.

The plan of ``composite`` copies each history to every assembly date that sees it. Here nothing is copied to dates before
the last step, so weekly assemblies of many years cost what was released in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import month_of, number
from tidemark.operators import pit, revisions, transforms
from tidemark.plans.composite import POOLED
from tidemark.registry import registry

UNIT = ["family", "unit", "frequency"]


def member_spans(spans: DataFrame) -> DataFrame:
    """Monthly values of each series as spans: means of weekly ones for as long as a whole month is known."""
    series = registry(spans.sparkSession, engine_only=True).select("series_id", "family", "transform", "frequency", "shift_days")
    rows = spans.join(F.broadcast(series), "series_id").withColumn("number", number(F.col("value_text")))
    weekly = F.col("frequency") == "weekly"
    day = F.when(weekly, F.date_add("observation_date", F.col("shift_days"))).otherwise(F.col("observation_date"))
    on_grid = (
        F.when(weekly, F.weekday("day") == 2)
        .when(F.col("frequency") == "quarterly", (F.dayofmonth("day") == 1) & F.month("day").isin(1, 4, 7, 10))
        .otherwise(F.dayofmonth("day") == 1)
    )
    rows = rows.where("number is not null and realtime_start <= realtime_end").withColumn("day", day).where(on_grid)
    keys = ["series_id", "family", "transform", "frequency", "month_idx"]
    rows = rows.withColumn("month_idx", month_of(F.col("day"))).select(*keys, "day", "number", "realtime_start", "realtime_end")
    # Only a weekly series has several observations a month.
    single = rows.where(~weekly).select(*keys, "realtime_start", "realtime_end", F.col("number").alias("value"))
    means = revisions.elementary(rows.where(weekly), keys).groupBy(*keys, "realtime_start", "realtime_end").agg(
        F.avg("number").alias("value"), F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day")
    )
    return single.unionByName(means.where(F.col("n") == transforms.wednesdays_in_month(F.col("last_day"))).drop("n", "last_day"))


def unit_spans(spans: DataFrame) -> DataFrame:
    """(family, unit, frequency, month_idx, realtime_start, realtime_end, value, error): what is scored, as spans."""
    members = member_spans(spans)
    pooled = F.col("transform") == POOLED
    level = members.where(~F.col("transform").isin(*transforms.GROWTH)).select(
        "family", F.col("series_id").alias("unit"), "frequency", "month_idx", "realtime_start", "realtime_end",
        transforms.level(F.col("transform"), F.col("value")).alias("value"), F.lit(False).alias("error"),
    )
    n_members = registry(spans.sparkSession, engine_only=True).groupBy("family").agg(F.count_if(pooled).alias("n_members"))
    growing = members.where(F.col("transform").isin(POOLED, "yoy_growth"))
    growing = revisions.with_prior(growing, ["series_id", "family", "transform", "frequency"]).join(F.broadcast(n_members), "family")
    keys = [*UNIT, "n_members", "month_idx"]
    growing = growing.withColumns(
        {
            "unit": F.when(pooled, F.col("family")).otherwise(F.col("series_id")),
            "frequency": F.when(pooled, "monthly").otherwise(F.col("frequency")),
            "n_members": F.when(pooled, F.col("n_members")).otherwise(1),
        }
    ).select(*keys, "realtime_start", "realtime_end", "value", "prior")
    sums = revisions.elementary(growing, keys).groupBy(*keys, "realtime_start", "realtime_end").agg(
        F.sum("value").alias("total"), F.sum("prior").alias("prior_total"), F.count(F.lit(1)).alias("there")
    )
    sums = sums.where("there = n_members").withColumn("error", F.col("prior_total") == 0)
    growth = F.when(~F.col("error"), -(F.col("total") - F.col("prior_total")) / F.col("prior_total"))
    return level.unionByName(sums.select(*UNIT, "month_idx", "realtime_start", "realtime_end", growth.alias("value"), "error"))


def unit_scores(spans: DataFrame, dates: DataFrame) -> DataFrame:
    """The score of each unit's latest point at every date, as ``composite.scored`` has it; an error anywhere voids the unit.

    Observations that are no number or off their grid are left out, as there; spans of one observation must not overlap.
    """
    units = unit_spans(spans)
    minimum = F.when(F.col("frequency") == "quarterly", transforms.MIN_QUARTERLY).otherwise(transforms.MIN_MONTHLY)
    found = revisions.trailing_scores(units, dates, UNIT, minimum=minimum)
    void = pit.as_of(units.where("error"), dates).select("assembly_date", "unit", F.lit(True).alias("void")).distinct()
    found = found.join(void, ["assembly_date", "unit"], "left")
    reason = F.when(F.col("void"), "invalid_transform").otherwise(F.concat(F.lit("z_abstention:"), F.col("reason")))
    return found.withColumns({"z": F.when(F.col("void").isNull(), F.col("z")), "reason": reason}).drop("void")
