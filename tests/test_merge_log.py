"""The store's tables as logs: what a batch costs, merging, compaction, vacuum."""

import os
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.schemas import SPANS
from tidemark.sources import mergelog, store


def size_of(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def spans(spark, rows, fetched=1):
    """rows: (series, day number, value, source)."""
    at = datetime(2020, 1, 1) + timedelta(hours=fetched)
    day = lambda n: date(2000, 1, 1) + timedelta(days=n)
    return spark.createDataFrame([(s, day(n), day(n), day(n + 9), v, source, None, at, at) for s, n, v, source in rows], SPANS)


def plain(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()))


def test_layouts_are_checked():
    with pytest.raises(ValueError):
        mergelog.Layout("a string, b long", ("a",), spread=("b",))
    with pytest.raises(ValueError):
        mergelog.Layout("a string, b long", ("a",), {"b": "median"})


def test_a_batch_writes_what_it_has(spark, tmp_path):
    s = store.VintageStore(spark, str(tmp_path))
    many = spark.range(40_000).select(
        F.concat(F.lit("S"), F.col("id") % 7).alias("series_id"),
        F.date_add(F.lit(date(1990, 1, 1)), (F.col("id") / 7).cast("int")).alias("observation_date"),
        F.lit(date(2020, 1, 1)).alias("realtime_start"), F.lit(date(2030, 1, 1)).alias("realtime_end"),
        F.sha2(F.col("id").cast("string"), 256).alias("value_text"), F.lit("first").alias("source"), F.lit(None).cast("string").alias("source_file"),
        F.lit(datetime(2020, 1, 1)).alias("first_fetched_at"), F.lit(datetime(2020, 1, 1)).alias("last_fetched_at"),
    )
    s.upsert_spans(many)
    whole, parts = size_of(tmp_path), set(os.listdir(tmp_path / "observation_spans"))
    new = many.where("series_id = 'S3' and observation_date < '1990-01-11'").withColumns({"value_text": F.lit("new"), "source": F.lit("second")})
    s.upsert_spans(new)
    assert size_of(tmp_path) - whole < whole / 20
    assert parts < set(os.listdir(tmp_path / "observation_spans"))
    # Only the buckets that the batch touches are merged: the others are scanned as they are.
    entry = mergelog.Entry.of(s.state()[1]["observation_spans"])
    count = entry.parts()
    assert len(count) == 32 and 0 < sum(n > 1 for n in count.values()) <= 10
    found = s.table("observation_spans")
    assert found.count() == 40_000
    assert plain(found.where("value_text = 'new'"), "source").count(("first",)) == 10  # the source is kept
    # A filter on the key reaches the scans of all parts.
    assert found.where("series_id = 'S3'")._jdf.queryExecution().executedPlan().toString().count("EqualTo(series_id,S3)") >= 2


def test_batches_equal_a_plain_merge(spark, tmp_path):
    """Many batches, with repeated keys within and across them, compactions of some buckets and a vacuum in between."""
    s, want = store.VintageStore(spark, str(tmp_path)), {}
    s.MOST_DELTAS = 5
    for n in range(1, 9):
        rows = [(f"S{k % 3}", (k * n) % 11, f"{n}.{k}", f"b{n}") for k in range(12)] + [("S0", 0, f"{n}.late", None)]
        batch = spans(spark, rows[:-1], n).unionByName(spans(spark, rows[-1:], n + 0.5))
        s.upsert_spans(batch)
        inside = {}
        for k, (series, day, value, source) in enumerate(rows):
            inside.setdefault((series, day), []).append((n + 0.5 if k == len(rows) - 1 else n, value, source))
        for key, versions in inside.items():
            last, first = max(v[0] for v in versions), min(v[0] for v in versions)
            values = {v[1] for v in versions if v[0] == last}, {v[2] for v in versions if v[0] == first}
            want.setdefault(key, []).append(values)
        if n in (3, 5):
            assert s.compact("observation_spans", 3 if n == 3 else 2) > 0
            s.vacuum(keep=1, older_than=0.0)
    found = {(r["series_id"], (r["observation_date"] - date(2000, 1, 1)).days): r for r in s.table("observation_spans").collect()}
    assert set(found) == set(want) and s.integrity_issues().count() == 0
    for key, versions in want.items():
        assert found[key]["value_text"] in versions[-1][0] and found[key]["source"] in versions[0][1]
    assert len(mergelog.Entry.of(s.state()[1]["observation_spans"]).deltas) <= 5


def test_rules_and_nulls(spark, tmp_path):
    s = store.VintageStore(spark, str(tmp_path))
    s.mark_backfilled("A", date(2020, 5, 1))
    s.mark_backfilled("A", date(2020, 1, 1))
    s.advance_coverage(spark.createDataFrame([("A", None, None), ("B", None, None)], "series_id string, complete_through date, last_backfill_at timestamp"))
    assert plain(s.table("series_coverage"), "series_id", "complete_through") == [("A", date(2020, 5, 1)), ("B", None)]
    assert s.table("series_coverage").where("last_backfill_at is null").count() == 2  # the newest mark, though it is null
    vintages = lambda n: spark.createDataFrame([("A", date(2020, 1, d), datetime(2020, 1, n)) for d in range(1, n + 1)], "series_id string, vintage_date date, fetched_at timestamp")
    for n in (3, 5):
        assert s.insert_vintages(vintages(n)) == n
    assert [r["fetched_at"].day for r in s.table("vintage_dates").orderBy("vintage_date").collect()] == [3, 3, 3, 5, 5]
    assert s.insert_vintages(vintages(3).limit(0)) == 0 and s.vintages_for("A").count() == 5


def test_vacuum_keeps_what_readers_and_writers_need(spark, tmp_path):
    s = store.VintageStore(spark, str(tmp_path))
    for n in range(4):
        s.upsert_spans(spans(spark, [("A", day, str(n), "x") for day in range(4)], n))
    before = s.snapshot()["observation_spans"]
    s.compact("observation_spans")
    # A part that nobody has named yet is a writer's; old parts are still those of the states that are kept.
    (tmp_path / "observation_spans/delta-unnamed").mkdir()
    assert s.vacuum(keep=16, older_than=3600) == [] and before.count() == 4
    gone = s.vacuum(keep=1, older_than=3600)
    assert [n.partition("/")[0] for n in gone] == ["states"] * 4 and before.count() == 4
    gone = s.vacuum(keep=1, older_than=0.0)
    assert "observation_spans/delta-unnamed" in gone and s.table("observation_spans").count() == 4
    assert [f for f in os.listdir(tmp_path / "states") if f.isdigit()] == ["00000005"]
    s.upsert_spans(spans(spark, [("A", 9, "9", "x")], 9))
    assert s.state()[0] == 6 and s.table("observation_spans").count() == 5
