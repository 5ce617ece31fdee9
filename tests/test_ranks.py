"""Expanding order statistics by descending the bits of ranks."""

import bisect
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bands, ranks
from tidemark.session import shared_folder


@pytest.mark.parametrize(("current", "stretch"), [(False, 7), (True, 1 << 16)])
def test_long_percentiles_equal_those_of_collected_histories(spark, current, stretch):
    rng = random.Random(3)
    rows = [(k, m, None if rng.random() < 0.1 else rng.choice([0.0, 1.5, -2.25, round(rng.gauss(0, 9), 6)])) for k, n in (("a", 60), ("b", 1), ("c", 35), (None, 9)) for m in range(n)]
    rows += [("d", m, None) for m in range(4)]
    panel = spark.createDataFrame(rows, "panel string, month_idx int, value double")
    want = bands.thresholds(panel, ["panel"], include_current=current, burn_in=1, minimum=1)
    got = ranks.expanding_percentiles(panel, ["panel"], ["month_idx"], "value", include_current=current, stretch=stretch)
    columns = ["panel", "month_idx", "reference_count", "p70", "p85", "p95"]
    plain = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert plain(got) == plain(want)
    assert got.columns == [*panel.columns, *columns[2:]]


def test_a_panel_of_a_hundred_thousand_rows(spark):
    n = 100_000
    panel = spark.range(n).select(F.lit(1).alias("panel"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(5_000_000)) / 100).alias("value"))
    got = ranks.expanding_percentiles(panel, ["panel"], ["t"], "value", percents=(85,)).collect()
    values = dict((r["t"], r["value"]) for r in got)
    cents, seen = {t: round(v * 100) for t, v in values.items()}, []
    found = {r["t"]: r for r in got}
    assert len(found) == n
    for t in range(n):
        if t and t % 97 == 0:
            at = (t - 1) * 85
            low, high = seen[at // 100], seen[min(at // 100 + 1, t - 1)]
            assert found[t]["reference_count"] == t and abs(found[t]["p85"] - (low * 100 + (high - low) * (at % 100)) / 10_000) < 1e-6
        bisect.insort(seen, cents[t])


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("v")).repartition(9)
    found = ranks.numbered(rows, ["k"], ["v"], "at").collect()
    for k in range(3):
        mine = sorted((r["at"], r["v"]) for r in found if r["k"] == k)
        assert [a for a, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


@pytest.mark.parametrize("current", [False, True])
def test_stretches_meet_all_values_that_their_percentiles_reach(spark, current):
    """Many stretches of 32 rows: a trend, falls, very few values, one value, and rows without any."""
    rng = random.Random(8)
    kinds = {
        "trend": lambda t: t * 1.5,
        "fall": lambda t: -1.0 * t if t < 300 else rng.gauss(0, 400),
        "few": lambda t: float(rng.choice([1, 1, 1, 2, 7])),
        "one": lambda t: 3.25,
        "late": lambda t: None if t < 100 or rng.random() < 0.3 else round(rng.gauss(0, 5), 3),
        "steps": lambda t: float(t // 150 % 3 * 100),
    }
    rows = [(k, t, f(t)) for k, f in kinds.items() for t in range(600 if k != "one" else 90)]
    panel = spark.createDataFrame(rows, "panel string, t int, value double")
    got = ranks.expanding_percentiles(panel, ["panel"], ["t"], "value", percents=(0, 50, 70, 85, 100), include_current=current, stretch=32).collect()
    assert len(got) == len(rows)
    found = {(r["panel"], r["t"]): r for r in got}
    for k in kinds:
        seen = []
        for _, t, v in [r for r in rows if r[0] == k]:
            new = [] if v is None else [round(v * 1_000_000)]
            past = sorted(seen + new * current)
            row = found[k, t]
            assert row["reference_count"] == len(past)
            for q in (0, 50, 70, 85, 100):
                low, part = divmod((len(past) - 1) * q, 100)
                want = (past[low] * 100 + (past[min(low + 1, len(past) - 1)] - past[low]) * part) / 1e8 if past else None
                assert row[f"p{q}"] == want if want is None else abs(row[f"p{q}"] - want) < 1e-6, (k, t, q)
            seen += new


def test_a_row_takes_few_bytes_of_the_shared_folders(spark):
    n, folders = 30_000, {f.removeprefix("file:") for f in (shared_folder(spark), spark.sparkContext.getCheckpointDir())}
    size = lambda: sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("*") if f.is_file())
    panel = spark.range(n).select(F.lit("a").alias("panel"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(5_000_000)) / 100).alias("value"))
    held = size()
    assert ranks.expanding_percentiles(panel, ["panel"], ["t"], "value", stretch=1 << 12).where("p70 is not null").count() == n - 1
    assert 0 < size() - held < 100 * n
