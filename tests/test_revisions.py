"""Scores from revisions against the as-of join, and what they cost."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.functions.values import month_start
from tidemark.operators import pit, revisions, transforms

DAY0 = date(2000, 1, 1)


def random_spans(spark, seed, months=30, series=3):
    """Months with several versions, gaps between some, some taken back, and late first ones."""
    rng, rows = random.Random(seed), []
    for s in range(series):
        for m in range(months):
            at = 30 * m + rng.randint(0, 90)
            for _ in range(rng.randint(1, 4)):
                length = rng.randint(1, 200)
                rows.append((f"S{s}", m, at, at + length - 1, round(rng.uniform(-5, 5), 2)))
                at += length + rng.choice([0, 0, 0, 20])
            if rng.random() < 0.7:
                rows.append((f"S{s}", m, at, 100_000, round(rng.uniform(-5, 5), 2)))
    days = lambda n: DAY0 + timedelta(days=n)
    return spark.createDataFrame([(s, m, days(a), days(b), v) for s, m, a, b, v in rows], "series_id string, month_idx int, realtime_start date, realtime_end date, value double")


def asked(spark, step):
    return spark.createDataFrame([(DAY0 + timedelta(days=n),) for n in range(0, 1300, step)], "assembly_date date")


def test_scores_equal_those_of_the_histories(spark):
    for seed, months, places in ((1, 12, None), (2, 12, 2), (3, 5, None), (4, 120, 2)):
        spans, dates = random_spans(spark, seed), asked(spark, 17)
        held = pit.as_of(spans.withColumn("observation_date", month_start(F.col("month_idx"))), dates)
        want = transforms.last_points(transforms.trailing_z(held, ["assembly_date", "series_id"], minimum=3, months=months), ["assembly_date", "series_id"])
        got = revisions.trailing_scores(spans, dates, ["series_id"], minimum=3, months=months, places=places)
        columns = ["assembly_date", "series_id", "month_idx", "value", "n_refs", F.bround("z", 6).alias("z"), "reason"]
        rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
        assert rows == sorted(map(tuple, want.select(*columns).collect()), key=str) and any(r[5] is not None for r in rows)


def test_changes_follow_the_spans_and_not_the_dates(spark):
    spans = random_spans(spark, 5).withColumn("v", F.col("value"))
    counts = []
    for step in (20, 2):
        latest = revisions.latest_months(spans, asked(spark, step), ["series_id"]).where("latest is not null").withColumn("era", F.lit(0))
        falls = latest.groupBy("series_id").agg(F.max("latest").alias("latest"))
        steady = latest.drop("latest").join(falls, "series_id")  # one era: the latest month never goes back
        counts.append(revisions.changes(spans, steady, ["series_id"], 12).count())
    assert max(counts) <= 2 * spans.count() and counts[1] <= 1.5 * counts[0]


def test_nothing_known_and_constant_windows(spark):
    spans, dates = random_spans(spark, 6), asked(spark, 50)
    assert revisions.trailing_scores(spans.limit(0), dates, ["series_id"]).count() == 0
    assert revisions.trailing_scores(spans, dates.limit(0), ["series_id"]).count() == 0
    for places in (None, 1):
        found = revisions.trailing_scores(spans.withColumn("value", F.lit(0.1)), dates, ["series_id"], minimum=2, places=places)
        assert {r["reason"] for r in found.where("n_refs >= 2").collect()} == {"zero_population_sigma"}


def test_stretches_of_overlapping_spans(spark):
    rows = [("A", date(2020, 1, 1), date(2020, 1, 10), 1), ("A", date(2020, 1, 5), date(2020, 1, 20), 2), ("A", date(2020, 2, 1), date(9999, 12, 31), 4)]
    found = revisions.elementary(spark.createDataFrame(rows, "k string, realtime_start date, realtime_end date, v int"), ["k"])
    sums = found.groupBy("realtime_start", "realtime_end").agg(F.sum("v")).orderBy("realtime_start").collect()
    days = [(r[0].isoformat(), r[1].isoformat(), r[2]) for r in sums]
    assert days == [("2020-01-01", "2020-01-04", 1), ("2020-01-05", "2020-01-10", 3), ("2020-01-11", "2020-01-20", 2), ("2020-02-01", "9999-12-31", 4)]
