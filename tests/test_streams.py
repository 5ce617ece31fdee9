"""Streams of months: restarts, order of arrival, initial state, and the log that they are written to."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bands
from tidemark.streaming import dwell, held, sink

COLUMNS = [c.split()[0] for c in dwell.OUTPUT.split(", ")]
MONTHS = "panel string, month_idx int, raw_band string, finalized_at timestamp"


def plain(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def run(stream, log, name, folder):
    query = stream.writeStream.foreachBatch(log.writer(name)).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_streamed_dwell_equals_batch(spark, tmp_path):
    raws = ["Normal", "Normal", "Watch", None, "Watch", "Watch", "High", "High", "Normal"]
    kind = "panel string, month_idx int, raw_band string"
    rows = [(p, i, r) for p in ("a", "b") for i, r in enumerate(raws)]
    log = sink.MonthLog(spark, str(tmp_path / "out"), dwell.OUTPUT)
    for part in (rows[:5] + rows[9:12], rows[5:9] + rows[12:], rows[2:4]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(dwell.dwell_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), log, "dwell", tmp_path / "check")
    want = plain(bands.dwell(spark.createDataFrame(rows, kind), ["panel"]))
    assert plain(log.read()) == want
    # The same months from another stream, as after a restart from the source, are kept once, as they were.
    log.writer("again")(log.read().withColumn("published_band", F.lit("other")), 0)
    assert plain(log.read()) == want


def test_months_in_any_order_with_initial_state(spark, tmp_path):
    """Out of order, doubled and late months; a restart in the middle; a new stream that goes on from what is frozen."""
    rng, day0 = random.Random(4), datetime(2020, 1, 1)
    rows = [(p, 100 + m, rng.choice(["Normal", "Watch", "High", None]), day0 + timedelta(days=30 * m)) for p in "ab" for m in range(24)]
    log, source, clock = sink.MonthLog(spark, str(tmp_path / "out"), dwell.OUTPUT), str(tmp_path / "in"), lambda n: ("~", None, None, day0 + timedelta(days=30 * n))

    def arrive(*months, end=None):
        part = [r for r in rows if r[1] - 100 in months]
        rng.shuffle(part)
        spark.createDataFrame(part + ([clock(end)] if end else []), MONTHS).coalesce(1).write.mode("append").parquet(source)

    def follow(name, **more):
        stream = spark.readStream.schema(MONTHS).option("maxFilesPerTrigger", 1).parquet(source)
        with held.state_store(spark):
            run(held.held_dwell(stream, delay="100 days", **more), log, name, tmp_path / name)

    arrive(0, 2, 4)
    arrive(1, 3, 2)
    follow("first")
    assert log.read().where("month_idx >= 101").count() == 0  # they wait for what may come before them
    arrive(5, 7)
    arrive(6, 8, 9)
    follow("first")  # restarted from its checkpoint
    frozen = log.read()
    assert plain(frozen.where("panel = 'a'")) and frozen.agg(F.max("month_idx")).first()[0] < 109
    # The rest by another stream over all files, which knows what is frozen; old months are refused.
    arrive(10, 12, 11)
    arrive(*range(13, 24), end=40)
    spark.createDataFrame([clock(41)], MONTHS).coalesce(1).write.mode("append").parquet(source)
    follow("second", frozen=spark.createDataFrame(frozen.collect(), frozen.schema))
    want = bands.dwell(spark.createDataFrame(rows, MONTHS), ["panel"])
    assert plain(log.read()) == plain(want)


def test_a_batch_costs_the_same_after_a_hundred(spark, tmp_path):
    log = sink.MonthLog(spark, str(tmp_path), dwell.OUTPUT)
    write, tracker, jobs = log.writer("s"), spark.sparkContext.statusTracker(), []
    row = lambda n: spark.createDataFrame([("a", n, None, None, None, 0, None)], dwell.OUTPUT).coalesce(1)
    for n in range(100):
        spark.sparkContext.setJobGroup(f"batch {n}", "")
        write(row(n), n)
        jobs.append(len(tracker.getJobIdsForGroup(f"batch {n}")))
        if n == 50:  # nothing that was written is read again
            (tmp_path / "gone").mkdir()
            for f in log.folders():
                (tmp_path / f).rename(tmp_path / "gone" / f)
    assert len(set(jobs)) == 1
    for f in (tmp_path / "gone").iterdir():
        f.rename(tmp_path / f.name)
    before = log.folders()
    write(row(1000), 7)  # delivered again, with other rows
    assert log.folders() == before and log.read().count() == 100
    # A batch that broke off before its entry is written anew; an entry that broke off names nothing.
    (tmp_path / "log/s.100").write_text('{"folder": ')
    assert log.read().count() == 100
    with pytest.raises(ValueError):
        log.writer("a/b")


def test_duplicates_within_the_watermark(spark, tmp_path):
    day = datetime(2020, 1, 1)
    rows = [("a", 1, "High", day), ("a", 1, "Watch", day), ("a", 2, "High", day + timedelta(days=30)), ("b", 1, None, day)]
    spark.createDataFrame(rows, MONTHS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, got = sink.deduplicated(spark.readStream.schema(MONTHS).parquet(str(tmp_path / "in")), "90 days"), []
    query = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and sorted((r["panel"], r["month_idx"]) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
