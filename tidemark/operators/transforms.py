"""From observations to scored series: monthly grids, growth rates, trailing scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import clamp, month_of

#: Trailing months, and the references needed for monthly and quarterly series.
WINDOW_MONTHS, MIN_MONTHLY, MIN_QUARTERLY, CAP = 120, 36, 20, 3.0


#: Transforms of a single observation, by tag; a deployment may add its own.
LEVELS: dict[str, Callable[[Column], Column]] = {
    "hundred_minus_level": lambda value: 100.0 - value,
    "inverted_level": lambda value: -value,
    "level": lambda value: value,
}
#: Transforms that need history: they are plans of their own.
GROWTH = ("pooled_yoy_growth", "yoy_growth", "quarterly_log_trend_gap_component")


def level(transform: Column, value: Column, levels: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Level transforms by tag; growth tags give null here, and a tag that nobody knows is an error."""
    found = F.when(transform.isin(*GROWTH), F.lit(None).cast("double"))
    for tag, make in (LEVELS if levels is None else levels).items():
        found = found.when(transform == tag, make(value))
    unknown = F.concat(F.lit("unknown transform: "), F.coalesce(transform, F.lit("none")))
    return found.otherwise(F.raise_error(unknown).cast("double"))


def wednesdays_in_month(day: Column) -> Column:
    """How many Wednesdays the month of a day has."""
    days = F.sequence(F.trunc(day, "MM"), F.last_day(day))
    return F.size(F.filter(days, lambda d: F.weekday(d) == 2))


def complete_month_means(rows: DataFrame, keys: list[str], day: str, value: str, shift_days: int = 0) -> DataFrame:
    """Means over the months of which every Wednesday is there; other months have none.

    ``shift_days`` moves observation dates to their canonical Wednesday first; days off it are left out.
    """
    moved = rows.withColumn("wed", F.date_add(day, shift_days)).where(F.weekday("wed") == 2)
    grouped = moved.groupBy(*keys, month_of(F.col("wed")).cast("int").alias("month_idx")).agg(
        F.avg(value).alias("value"), F.count_distinct("wed").cast("int").alias("weeks"), F.max("wed").alias("last_wed")
    )
    return grouped.where(F.col("weeks") == wednesdays_in_month(F.col("last_wed"))).drop("last_wed")


def year_ago(value: str, keys: list[str], month: str = "month_idx") -> Column:
    """The value exactly twelve months before: a range frame, as lag(12) would count rows over gaps."""
    window = Window.partitionBy(*keys).orderBy(month).rangeBetween(-12, -12)
    return F.first(value).over(window)


def yoy_growth(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(value - prior) / prior with sign turned, for months with a prior; a prior of zero is an error row."""
    found = rows.withColumn("prior", year_ago(value, keys)).where("prior is not null")
    return found.withColumn("error", F.col("prior") == 0).withColumn(
        "growth", F.when(~F.col("error"), -(F.col(value) - F.col("prior")) / F.col("prior"))
    )


def pooled_yoy(rows: DataFrame, family: list[str], member: str, n_members: int, value: str = "value") -> DataFrame:
    """The pooled growth of a family, only for months in which every member has a value and a prior one."""
    found = rows.withColumn("prior", year_ago(value, [*family, member]))
    pooled = found.groupBy(*family, "month_idx").agg(
        F.count("prior").alias("members"), F.sum(value).alias("total"), F.sum("prior").alias("prior_total")
    )
    pooled = pooled.where(F.col("members") == n_members)
    return pooled.withColumn("error", F.col("prior_total") == 0).withColumn(
        "growth", F.when(~F.col("error"), -(F.col("total") - F.col("prior_total")) / F.col("prior_total"))
    )


def trailing_z(
    rows: DataFrame, keys: list[str], value: str = "value", minimum: int = MIN_MONTHLY, months: int = WINDOW_MONTHS, ddof: int = 0
) -> DataFrame:
    """Each point against the population of the ``months`` before it: z, its references and a reason if there is none."""
    window = Window.partitionBy(*keys).orderBy("month_idx").rangeBetween(-months, -1)
    spread = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value).over(window)
    scored = rows.withColumns({"n_refs": F.count(value).over(window), "mean": F.avg(value).over(window), "sigma": spread})
    reason = (
        F.when(F.col("n_refs") < minimum, F.format_string("insufficient_history:%d<%d", "n_refs", F.lit(minimum)))
        .when(F.isnan(value) | F.col(value).isNull() | (F.abs(value) == float("inf")), "non_finite_value")
        .when(F.col("sigma") <= 0, "zero_population_sigma")
    )
    scored = scored.withColumn("reason", reason)
    z = F.when(F.col("reason").isNull(), (F.col(value) - F.col("mean")) / F.col("sigma"))
    return scored.withColumn("z", clamp(z, CAP)).drop("mean", "sigma")


def last_points(rows: DataFrame, keys: list[str], order: str = "month_idx") -> DataFrame:
    """The latest point of each key, by a partial aggregate."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("p")).select(*keys, "p.*")


def numeric_issues(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A code for each observation: missing mark, no number, duplicate, or null if it is fine; and the number."""
    from tidemark.functions.values import MISSING, number

    repeated = F.count(F.lit(1)).over(Window.partitionBy(*keys, "observation_date"))
    value = number(F.col("value_text"))
    code = (
        F.when(repeated > 1, "duplicate_observation")
        .when(F.col("value_text") == MISSING, "missing_value")
        .when(value.isNull(), "invalid_value")
    )
    return rows.withColumns({"number": F.when(code.isNull(), value), "code": code})


def staleness(rows: DataFrame, keys: list[str], assembly: str, limit: Column) -> DataFrame:
    """Per key: the age of the newest release over the whole history, and whether it is stale or from the future."""
    newest = rows.groupBy(*keys).agg(F.max("release_date").alias("newest_release"))
    age = F.datediff(F.col(assembly), F.col("newest_release"))
    return newest.withColumn("age_days", age).withColumns(
        {
            "stale": F.col("age_days").isNull() | (F.col("age_days") > limit),
            "reason": F.when(F.col("age_days").isNull(), "missing_release")
            .when(F.col("age_days") < 0, "future_release")
            .when(F.col("age_days") > limit, "stale"),
        }
    )
