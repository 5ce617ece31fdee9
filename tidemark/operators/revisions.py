"""Scores at all assembly dates from revisions: each span is a pair of signed changes, summed over dates.

An as-of join followed by a trailing window costs dates times history. But between two dates only what was revised
changes, and what the window gains or loses as the latest month moves on. So a span counts in the window of a date from
the first date that knows it and whose window has come to its month, until it is replaced or the window has passed: two
changes of count, sum and sum of squares, whatever the number of dates. Prefix sums over dates give every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import clamp
from tidemark.operators import pit
from tidemark.operators.transforms import CAP, MIN_MONTHLY, WINDOW_MONTHS
from tidemark.session import cut

SUMS = ("n", "s1", "s2")


def elementary(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans of each key cut at one another's bounds, so that those of a stretch have equal bounds and can be grouped.

    Work follows the revisions of a key, say a month: none of its stretches is looked at for any date.
    """
    bounds = spans.select(*keys, F.explode(F.array("realtime_start", F.date_add("realtime_end", 1))).alias("low")).distinct()
    following = F.lead("low").over(Window.partitionBy(*keys).orderBy("low"))
    stretches = bounds.withColumn("high", F.date_sub(following, 1)).where("high is not null")
    parts = spans.join(stretches, keys).where((F.col("realtime_start") <= F.col("low")) & (F.col("high") <= F.col("realtime_end")))
    return parts.drop("realtime_start", "realtime_end").withColumnsRenamed({"low": "realtime_start", "high": "realtime_end"})


def with_prior(spans: DataFrame, keys: list[str], value: str = "value", months: int = 12) -> DataFrame:
    """Spans in which both a month and the one ``months`` before it hold, with that one's value as ``prior``."""
    earlier = spans.select(
        *keys, (F.col("month_idx") + months).alias("month_idx"), F.col(value).alias("prior"),
        F.col("realtime_start").alias("prior_start"), F.col("realtime_end").alias("prior_end"),
    )
    both = spans.join(earlier, [*keys, "month_idx"]).withColumns(
        {"realtime_start": F.greatest("realtime_start", "prior_start"), "realtime_end": F.least("realtime_end", "prior_end")}
    )
    return both.where("realtime_start <= realtime_end").drop("prior_start", "prior_end")


def _asked(spans: DataFrame, dates: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    """Every key with every date: the rows of the answer. The dates are those of the calendar, a bounded list."""
    days = dates.select(F.col(date_col).alias("day")).where("day is not null").distinct()
    return spans.select(*keys).distinct().crossJoin(F.broadcast(days))


def latest_months(spans: DataFrame, dates: DataFrame, keys: list[str], date_col: str = "assembly_date") -> DataFrame:
    """(keys, day, latest): the last month that is known at each date; null before the first one.

    The stretches in which a month is known that last to the end of what its key knows give a running maximum. Only months
    that are taken back before are looked up date by date.
    """
    order = Window.partitionBy(*keys, "month_idx").orderBy("realtime_start")
    before = F.max("realtime_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("begins", (F.col("realtime_start") > F.date_add(before, 1)) | before.isNull())
    islands = islands.withColumn("island", F.sum(F.col("begins").cast("int")).over(order))
    known = islands.groupBy(*keys, "month_idx", "island").agg(F.min("realtime_start").alias("realtime_start"), F.max("realtime_end").alias("realtime_end"))
    known = known.withColumn("through", F.max("realtime_end").over(Window.partitionBy(*keys)))
    asked = _asked(spans, dates, keys, date_col)
    lasting = known.where("realtime_end = through").select(*keys, F.col("realtime_start").alias("day"), "month_idx", "through", F.lit(False).alias("asks"))
    both = lasting.unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    running = both.withColumns({"latest": F.max("month_idx").over(so_far), "through": F.max("through").over(so_far)}).where("asks")
    running = running.select(*keys, "day", F.when(F.col("day") <= F.col("through"), F.col("latest")).alias("lasting"))
    taken = pit.as_of(known.where("realtime_end < through").drop("through", "island"), dates, date_col)
    taken = taken.groupBy(*keys, F.col(date_col).alias("day")).agg(F.max("month_idx").alias("taken"))
    return running.join(taken, [*keys, "day"], "left").select(*keys, "day", F.greatest("lasting", "taken").alias("latest"))


def _visits(latest: DataFrame, spans: DataFrame, keys: list[str], months: int) -> DataFrame:
    """(keys, era, month_idx, enters, leaves, ends): the days at which a month enters and leaves the window.

    An era is a time in which the latest month never goes back. ``leaves`` is null if the month stays to the era's end.
    """
    eras = latest.groupBy(*keys, "era", "latest").agg(F.min("day").alias("day"), F.max("day").alias("last"))
    whole = eras.groupBy(*keys, "era").agg(F.max("last").alias("ends"))
    wanted = spans.select(*keys, "month_idx").distinct().join(whole, keys)
    # The window of latest month m has the months from m - months to m - 1.
    probes = wanted.select("*", F.explode(F.array(F.lit(1), F.lit(months + 1))).alias("shift"))
    probes = probes.withColumn("latest", F.col("month_idx") + F.col("shift"))
    both = eras.select(*keys, "era", "latest", "day").unionByName(probes, allowMissingColumns=True)
    # The first day at which the latest month is the probe's or a later one.
    later = Window.partitionBy(*keys, "era").orderBy("latest", F.col("shift").isNull()).rowsBetween(0, Window.unboundedFollowing)
    reached = both.withColumn("reached", F.first("day", ignorenulls=True).over(later)).where("shift is not null")
    return reached.groupBy(*keys, "era", "month_idx").agg(
        F.max(F.when(F.col("shift") == 1, F.col("reached"))).alias("enters"),
        F.max(F.when(F.col("shift") > 1, F.col("reached"))).alias("leaves"),
        F.max("ends").alias("ends"),
    )


def changes(spans: DataFrame, latest: DataFrame, keys: list[str], months: int = WINDOW_MONTHS) -> DataFrame:
    """(keys, era, day, n, s1, s2): what each span adds to the windows of its keys, and takes away again.

    ``latest`` has keys, era, day and latest; ``spans`` an exact or centred ``v``. There are at most two rows a span and era,
    however many dates are asked for.
    """
    placed = spans.join(_visits(latest, spans, keys, months), [*keys, "month_idx"])
    begins = F.greatest("realtime_start", "enters")
    ends = F.least(F.date_add("realtime_end", 1), "leaves", F.date_add("ends", 1))
    placed = placed.where("enters is not null").withColumns({"begins": begins, "goes": ends}).where("begins < goes")
    signed = F.array(F.struct(F.col("begins").alias("day"), F.lit(1).alias("sign")), F.struct(F.col("goes").alias("day"), F.lit(-1).alias("sign")))
    moved = placed.select(*keys, "era", "v", F.explode(signed).alias("c"))
    sign = F.col("c.sign")
    return moved.select(*keys, "era", F.col("c.day").alias("day"), sign.cast("long").alias("n"), (sign * F.col("v")).alias("s1"), (sign * F.col("v") * F.col("v")).alias("s2"))


def trailing_scores(
    spans: DataFrame,
    dates: DataFrame,
    keys: list[str],
    date_col: str = "assembly_date",
    value: str = "value",
    minimum: int | Column = MIN_MONTHLY,
    months: int = WINDOW_MONTHS,
    places: int | None = None,
) -> DataFrame:
    """The latest point of each key at each date, scored against the ``months`` before it as they were known then.

    ``spans`` has keys, month_idx, realtime_start, realtime_end and a value; spans of one month don't overlap. Returned are
    keys, the date, month_idx, value, n_refs, z and a reason where there is no score; dates at which a key knows nothing
    have no row. Null values are not known. With ``places`` values are taken as exact decimals of so many places, and sums
    are exact; else they are centred by the mean of their key before squares are summed.
    """
    spans = spans.where(F.col(value).isNotNull() & (F.col("realtime_start") <= F.col("realtime_end")))
    spans = spans.select(*keys, "month_idx", "realtime_start", "realtime_end", F.col(value).alias("value"))
    if places is None:
        centre = F.avg("value").over(Window.partitionBy(*keys))
        spans = spans.withColumn("centre", centre).withColumn("v", F.col("value") - F.col("centre"))
        zero, sums = F.lit(0.0), lambda c: F.sum(c)
    else:
        scaled = F.round(F.col("value").cast("decimal(38,10)") * F.lit(10**places).cast("decimal(20,0)")).cast("decimal(18,0)")
        spans = spans.withColumn("v", scaled).withColumn("centre", F.lit(0.0))
        zero, sums = F.lit(0).cast("decimal(38,0)"), lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    spans = cut(spans)  # both are read several times
    latest = cut(latest_months(spans, dates, keys, date_col).where("latest is not null"))
    order = Window.partitionBy(*keys).orderBy("day")
    back = F.coalesce((F.col("latest") < F.lag("latest").over(order)).cast("int"), F.lit(0))
    latest = latest.withColumn("back", back).withColumn("era", F.sum("back").over(order)).drop("back")
    moved = changes(spans, latest, keys, months).groupBy(*keys, "era", "day").agg(*[sums(c).alias(c) for c in SUMS])
    both = moved.withColumn("latest", F.lit(None).cast("int")).unionByName(latest, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "era").orderBy("day", F.col("latest").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumns({c: sums(c).over(so_far) for c in SUMS}).where("latest is not null")
    points = summed.withColumnRenamed("latest", "month_idx").join(spans, [*keys, "month_idx"])
    points = points.where((F.col("realtime_start") <= F.col("day")) & (F.col("day") <= F.col("realtime_end")))
    n = F.coalesce(F.col("n").cast("long"), F.lit(0))
    # n squared times the variance: exact for decimals.
    spread = n.cast("decimal(10,0)" if places is not None else "double") * F.coalesce("s2", zero) - F.coalesce("s1", zero) * F.coalesce("s1", zero)
    if places is None:
        # What cancellation leaves of a constant window is no variance.
        spread = F.when(spread > 1e-12 * n * F.coalesce("s2", zero), spread).otherwise(F.lit(0.0))
    unit = 1.0 if places is None else float(10**places)
    points = points.withColumns({"n_refs": n, "spread": spread.cast("double")})
    reason = (
        F.when(F.col("n_refs") < minimum, F.format_string("insufficient_history:%d<%d", "n_refs", F.lit(minimum)))
        .when(F.isnan("value") | (F.abs("value") == float("inf")), "non_finite_value")
        .when(F.col("spread") <= 0, "zero_population_sigma")
    )
    off = F.col("n_refs") * (F.col("v").cast("double") / unit) - F.col("s1").cast("double") / unit
    points = points.withColumn("reason", reason)
    z = F.when(F.col("reason").isNull(), off / (F.sqrt("spread") / unit))
    return points.select(*keys, F.col("day").alias(date_col), "month_idx", "value", "n_refs", clamp(z, CAP).alias("z"), "reason")
