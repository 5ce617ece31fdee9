"""Outcome gaps, lead events, episode scoring, calibration and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import BANDS, regime

TREND, EVENT, EPSILON = 8, -2.0, 1e-12


def trend_gap(levels: DataFrame, keys: list[str], quarters: int = TREND) -> DataFrame:
    """Per cent by which each level misses the log-linear trend of the ``quarters`` before it, all of which it needs."""
    window = Window.partitionBy(*keys).orderBy("quarter_idx").rangeBetween(-quarters, -1)
    y, x = F.ln("level"), F.col("quarter_idx").cast("double")
    rows = levels.withColumn("log_level", F.when(F.col("level") > 0, y))
    rows = rows.withColumns(
        {
            "n": F.count("log_level").over(window),
            "slope": F.regr_slope("log_level", x).over(window),
            "intercept": F.regr_intercept("log_level", x).over(window),
        }
    )
    gap = 100.0 * (F.exp(F.col("log_level") - (F.col("intercept") + F.col("slope") * x)) - 1.0)
    return rows.withColumn("gap", F.when(F.col("n") == quarters, gap)).drop("n", "slope", "intercept", "log_level")


def outcome_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both components' gaps by quarter (full outer), their mean and the event; reasons where one is missing."""
    a = first.select("quarter_idx", F.col("gap").alias("gap_one"), F.lit(True).alias("has_one"))
    b = second.select("quarter_idx", F.col("gap").alias("gap_two"), F.lit(True).alias("has_two"))
    both = a.join(b, "quarter_idx", "full_outer")
    reason = F.when(F.col("has_one").isNull() | F.col("has_two").isNull(), "missing_component").when(
        F.col("gap_one").isNull() | F.col("gap_two").isNull(), "insufficient_trend_history"
    )
    both = both.withColumn("reason", reason)
    gap = F.when(F.col("reason").isNull(), (F.col("gap_one") + F.col("gap_two")) / 2.0)
    both = both.withColumn("gap", gap)
    return both.withColumn("event", F.col("gap") <= EVENT + EPSILON).drop("has_one", "has_two")


def lead_events(months: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Whether either of the two quarters after a month has an event; a reason if that can't be said."""
    quarter = F.floor(F.col("month_idx") / 3).cast("int")
    one = outcomes.select((F.col("quarter_idx") - 1).alias("q"), F.lit(True).alias("is_one"), F.col("event").alias("event_one"))
    two = outcomes.select((F.col("quarter_idx") - 2).alias("q"), F.lit(True).alias("is_two"), F.col("event").alias("event_two"))
    found = months.withColumn("q", quarter).join(one, "q", "left").join(two, "q", "left")
    reason = F.when(F.col("is_one").isNull() | F.col("is_two").isNull(), "outcome_unavailable").when(
        F.col("event_one").isNull() | F.col("event_two").isNull(), "outcome_abstention"
    )
    found = found.withColumn("outcome_reason", reason)
    event = F.when(F.col("outcome_reason").isNull(), F.col("event_one") | F.col("event_two"))
    return found.withColumn("outcome_event", event).drop("q", "is_one", "is_two", "event_one", "event_two")


def score_signals(rows: DataFrame, keys: list[str], window_months: int = 6) -> DataFrame:
    """Episode onset, status, hit and regimes of monthly signals with their outcome events.

    A month without a signal doesn't continue an episode: the next positive month starts a new one.
    """
    order = Window.partitionBy(*keys).orderBy("month_idx")
    onset = F.coalesce(F.col("signal"), F.lit(False)) & ~F.coalesce(F.lag("signal").over(order), F.lit(False))
    status = F.when(F.col("signal").isNull(), "signal_abstention").when(
        F.col("outcome_event").isNull(), "outcome_abstention"
    ).otherwise("scored")
    cycle, turning = regime(F.col("month_idx"), window_months)
    return rows.withColumns({"episode_onset": onset, "score_status": status}).withColumns(
        {
            "hit": F.when(F.col("score_status") == "scored", F.col("signal") & F.col("outcome_event")),
            "business_cycle": cycle,
            "turning_context": turning,
        }
    )


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of points, abstentions, episodes and hits, and the lead rate: hits per scored episode."""
    scored = F.col("score_status") == "scored"
    episode = scored & F.col("episode_onset")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(scored).alias("scorable"),
        F.count_if(F.col("score_status") == "signal_abstention").alias("signal_abstentions"),
        F.count_if(F.col("score_status") == "outcome_abstention").alias("outcome_abstentions"),
        F.count_if(F.col("episode_onset")).alias("episodes"),
        F.count_if(episode).alias("scored_episodes"),
        F.count_if(episode & F.col("hit")).alias("hits"),
    )
    return out.withColumn("lead_rate", F.when(F.col("scored_episodes") > 0, F.col("hits") / F.col("scored_episodes")))


def calibration(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Events per band, for all four bands, and whether the probabilities never fall (null unless all have one)."""
    bands = spark.createDataFrame([(n, b) for n, b in enumerate(BANDS)], "ord int, band string")
    seen = rows.where("outcome_event is not null and signal is not null").groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("outcome_event").alias("events")
    )
    table = F.broadcast(bands).join(seen, "band", "left").select(
        "ord", "band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("events", F.lit(0)).alias("events")
    )
    table = table.withColumn("probability", F.when(F.col("n") > 0, F.col("events") / F.col("n")))
    every, order = Window.partitionBy(), Window.partitionBy().orderBy("ord")  # four rows
    fell = F.lag("probability").over(order) > F.col("probability") + 1e-9 * F.col("probability")
    table = table.withColumn("fell", F.coalesce(fell, F.lit(False)))
    known = F.count("probability").over(every) == len(BANDS)
    return table.withColumn("monotonic", F.when(known, ~F.max("fell").over(every))).drop("fell")


def regime_macro(rows: DataFrame) -> DataFrame:
    """Lead rates by regime category, and their mean for a dimension whose two categories both have one."""
    long = rows.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("business_cycle").alias("dimension"), F.col("business_cycle").alias("category")),
                F.struct(F.lit("turning_context").alias("dimension"), F.col("turning_context").alias("category")),
            )
        ).alias("r"),
    ).withColumns({"dimension": F.col("r.dimension"), "category": F.col("r.category")})
    slices = summarize(long, ["dimension", "category"])
    both = Window.partitionBy("dimension")
    return slices.withColumn(
        "macro_lead_rate", F.when(F.count("lead_rate").over(both) == 2, F.avg("lead_rate").over(both))
    )
