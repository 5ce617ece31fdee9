"""Operators against pinned vectors and plain-Python twins."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import autoregression, bands, baselines, compare, compose, outcomes, pit, transforms
from tidemark.plans import checker

MONTHS = "key string, month_idx int, value double"


def monthly(spark, values, key="k", start=24000):
    return spark.createDataFrame([(key, start + i, v) for i, v in enumerate(values) if v is not None], MONTHS)


def test_as_of_is_inclusive_and_caps_the_end(spark):
    spans = spark.createDataFrame(
        [("A", date(2013, 4, 1), date(2013, 5, 13), date(2013, 6, 12), "1.0"), ("A", date(2013, 4, 1), date(2013, 6, 13), date(9999, 12, 31), "1.1")],
        "series_id string, observation_date date, realtime_start date, realtime_end date, value_text string",
    )
    days = [date(2013, 5, 12), date(2013, 5, 13), date(2013, 6, 12), date(2013, 6, 13)]
    dates = spark.createDataFrame([(d,) for d in days], "assembly_date date")
    got = {r["assembly_date"]: r for r in pit.as_of(spans, dates).collect()}
    assert {d: r["value_text"] for d, r in got.items()} == {days[1]: "1.0", days[2]: "1.0", days[3]: "1.1"}
    assert got[days[1]]["available_through"] == days[1]
    strict = {r["assembly_date"]: r["value_text"] for r in pit.as_of(spans, dates, inclusive_start=False).collect()}
    assert strict == {days[2]: "1.0"}
    assert pit.as_of(spans.limit(0), dates).count() == 0 and pit.as_of(spans, dates.limit(0)).count() == 0


def test_upsert_keeps_first_fetch_and_source(spark):
    kind = "series_id string, observation_date date, realtime_start date, value_text string, first_fetched_at int, source string, source_file string"
    old = spark.createDataFrame([("A", date(2020, 1, 1), date(2020, 2, 1), "1", 1, "old", None)], kind)
    new = spark.createDataFrame(
        [("A", date(2020, 1, 1), date(2020, 2, 1), "2", 9, "new", "f"), ("B", date(2020, 1, 1), date(2020, 2, 1), "3", 9, "new", "f")], kind
    )
    got = {r["series_id"]: r for r in pit.upsert(old, new).collect()}
    assert (got["A"]["value_text"], got["A"]["first_fetched_at"], got["A"]["source"], got["A"]["source_file"]) == ("2", 1, "old", None)
    assert got["B"]["source"] == "new" and len(got) == 2


def test_weekly_means_need_whole_months(spark):
    wednesdays = [date(2024, 1, d) for d in (3, 10, 17, 24, 31)]
    rows = [("A", d, float(i + 1)) for i, d in enumerate(wednesdays)] + [("B", d, 1.0) for d in wednesdays if d.day != 17]
    rows += [("C", date(2024, 1, d.day - 2), 2.0 * (i + 1)) for i, d in enumerate(wednesdays)]
    frame = spark.createDataFrame(rows, "key string, day date, value double")
    got = transforms.complete_month_means(frame.where("key <> 'C'"), ["key"], "day", "value").collect()
    assert [(r["key"], r["value"]) for r in got] == [("A", 3.0)]
    shifted = transforms.complete_month_means(frame.where("key = 'C'"), ["key"], "day", "value", 2).first()
    assert shifted["value"] == 6.0


def test_pool_needs_every_member(spark):
    rows = [("f", "A", 24000, 100.0), ("f", "A", 24012, 80.0), ("f", "B", 24000, 300.0), ("f", "B", 24012, 330.0), ("f", "A", 24013, 1.0)]
    frame = spark.createDataFrame(rows, "family string, member string, month_idx int, value double")
    got = transforms.pooled_yoy(frame, ["family"], "member", 2).collect()
    assert [(r["month_idx"], r["growth"]) for r in got] == [(24012, -0.025)]


def test_growth_looks_back_twelve_months_not_rows(spark):
    got = transforms.yoy_growth(monthly(spark, [1.0] + [None] * 11 + [2.0, 5.0]), ["key"]).collect()
    assert [(r["month_idx"], r["growth"]) for r in got] == [(24012, -1.0)]


def test_trailing_z(spark):
    got = transforms.trailing_z(monthly(spark, [float(i) for i in range(37)]), ["key"])
    rows = {r["month_idx"] - 24000: r for r in got.collect()}
    sigma = math.sqrt(sum((i - 17.5) ** 2 for i in range(36)) / 36)
    assert rows[36]["z"] == pytest.approx((36 - 17.5) / sigma) and rows[36]["reason"] is None
    assert rows[35]["z"] is None and rows[35]["reason"] == "insufficient_history:35<36"
    flat = transforms.trailing_z(monthly(spark, [0.1] * 40), ["key"]).where("month_idx = 24039").first()
    assert flat["z"] is None and flat["reason"] == "zero_population_sigma"
    high = transforms.trailing_z(monthly(spark, [float(i % 2) for i in range(40)] + [99.0]), ["key"]).where("month_idx = 24040").first()
    assert high["z"] == 3.0


@pytest.mark.parametrize("dwell", [1, 2, 3])
def test_dwell_equals_the_state_machine(spark, dwell):
    rng = random.Random(dwell)
    rows, want = [], {}
    for panel in range(40):
        raws = [rng.choice(["Normal", "Watch", "High", None]) for _ in range(30)]
        rows += [(f"p{panel}", i, r) for i, r in enumerate(raws)]
        confirmed = candidate = None
        count = 0
        for i, raw in enumerate(raws):
            if raw is None or raw == confirmed:
                candidate, count = None, 0
            else:
                count = count + 1 if raw == candidate else 1
                candidate = raw
                if count >= dwell:
                    confirmed, candidate, count = raw, None, 0
            want[f"p{panel}", i] = (confirmed, candidate, count, confirmed if raw else None)
    frame = spark.createDataFrame(rows, "key string, month_idx int, raw_band string")
    for r in bands.dwell(frame, ["key"], months=dwell).collect():
        assert (r["confirmed_band"], r["candidate_band"], r["candidate_count"], r["published_band"]) == want[r["key"], r["month_idx"]]


def test_bands_after_burn_in(spark):
    values = [float(i) for i in range(35)] + [100.0, 102.0]
    rows = bands.dwell(bands.raw_band(bands.thresholds(monthly(spark, values), ["key"])), ["key"])
    got = {r["month_idx"] - 24000: r for r in rows.collect()}
    assert not got[34]["eligible"] and got[34]["raw_band"] is None
    assert (got[35]["raw_band"], got[35]["candidate_band"], got[35]["candidate_count"], got[35]["published_band"]) == ("High", "High", 1, None)
    assert got[36]["published_band"] == "High"
    twin = checker.replay_bands(values)
    for i, t in enumerate(twin):
        cuts = t.pop("thresholds") or (None, None, None)
        assert {k: got[i][k] for k in t} == t and cuts == tuple(got[i][p] for p in ("p70", "p85", "p95"))
    drifted = checker.replay_bands(values, checker.Rules(dwell=1))
    assert drifted[35]["published_band"] == "High"


def test_tiers(spark):
    f = compose.LEADING
    rows = []
    for day, zs in {1: (1.0, 2.0, 3.0, 4.0), 2: (1.0, None, 3.0, 4.0), 3: (None, None, 3.0, 4.0)}.items():
        rows += [(day, f[i], "B" if i == 1 else "A", z) for i, z in enumerate(zs)]
    got = {r["day"]: r for r in compose.tiers(spark.createDataFrame(rows, "day int, family string, tier string, z double"), ["day"]).collect()}
    assert (got[1]["tier_b"], got[1]["headline_tier"], list(got[1]["flags"])) == (2.5, "B", [])
    assert got[2]["headline"] == got[2]["tier_a"] == pytest.approx(2.666667) and got[2]["headline_tier"] == "A"
    assert list(got[2]["flags"]) == ["family_abstention:visa_smi", "leading_renormalized:visa_smi"]
    assert got[3]["abstained"] and got[3]["headline"] is None
    assert list(got[3]["flags"])[-1] == "leading_abstained:2_of_4_families"


def test_outcome_gap_and_event(spark):
    def level(base, step, shock):
        return [(8060 + k, base * math.exp(step * k) * (shock if k == 8 else 1.0)) for k in range(9)]

    kind = "quarter_idx int, level double"
    one = outcomes.trend_gap(spark.createDataFrame(level(100, 0.02, 0.97), kind).withColumn("c", F.lit(1)), ["c"])
    two = outcomes.trend_gap(spark.createDataFrame(level(10000, 0.01, 0.99), kind).withColumn("c", F.lit(1)), ["c"])
    got = outcomes.outcome_gaps(one, two).where("quarter_idx = 8068").first()
    assert (got["gap_one"], got["gap_two"], got["gap"]) == (pytest.approx(-3.0), pytest.approx(-1.0), pytest.approx(-2.0))
    assert got["event"] and got["reason"] is None
    lone = outcomes.outcome_gaps(one, two.where("quarter_idx <> 8067")).where("quarter_idx = 8067").first()
    assert lone["reason"] == "missing_component" and lone["event"] is None


def test_lead_quarters_and_episodes(spark):
    gaps = spark.createDataFrame([(2020 * 4, True), (2020 * 4 + 1, False), (2019 * 4 + 3, None)], "quarter_idx int, event boolean")
    months = spark.createDataFrame([(2019 * 12 + 11,), (2019 * 12 + 8,), (2020 * 12 + 5,)], "month_idx int")
    got = {r["month_idx"]: (r["outcome_event"], r["outcome_reason"]) for r in outcomes.lead_events(months, gaps).collect()}
    assert got == {24239: (True, None), 24236: (None, "outcome_abstention"), 24245: (None, "outcome_unavailable")}
    signals = [True, True, None, True, False, True]
    frame = spark.createDataFrame([("s", i, s, True) for i, s in enumerate(signals)], "k string, month_idx int, signal boolean, outcome_event boolean")
    scored = outcomes.score_signals(frame, ["k"])
    assert [r["episode_onset"] for r in scored.orderBy("month_idx").collect()] == [True, False, False, True, False, True]
    total = outcomes.summarize(scored, ["k"]).first()
    assert (total["episodes"], total["hits"], total["lead_rate"], total["signal_abstentions"]) == (3, 3, 1.0, 1)


def test_baselines(spark):
    one = spark.range(1)
    train = F.array(*[F.lit(float(i)) for i in range(24)])
    error = baselines.mase(train, F.array(F.lit(24.0), F.lit(25.0)), F.array(F.lit(23.0), F.lit(27.0)))
    assert one.select(error).first()[0] == 0.125
    path = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = one.select(baselines.path_signal(path(0, 1, 0, 1), F.lit(0.5)), baselines.path_signal(path(0, 1, 1, 0), F.lit(0.5)), baselines.path_signal(path(0, 1), F.lit(None).cast("double"))).first()
    assert list(got) == [False, True, None]
    naive = one.select(baselines.seasonal_naive(train, 6)).first()[0]
    assert naive == [12.0, 13.0, 14.0, 15.0, 16.0, 17.0]


def test_autoregression_recovers_its_process(spark):
    """Every origin's forecast from running sums, against least squares over its own history."""
    import numpy as np

    rng = random.Random(1)
    x = [0.0, 1.0]
    for _ in range(120):
        x.append(0.5 + 0.6 * x[-1] - 0.3 * x[-2] + rng.gauss(0, 0.2))
    rows = spark.createDataFrame([("k", i, [v]) for i, v in enumerate(x)] + [("zero", i, [0.0]) for i in range(60)], "key string, month_idx int, v array<double>")
    found = {(r["key"], r["month_idx"]): r for r in autoregression.forecasts(rows, ["key"], "v", 1, 2, 3, 36).collect()}
    assert len(found) == len(x) + 60
    for t in range(len(x)):
        r = found["k", t]
        if t + 1 < 36:
            assert (r["forecast"], r["reason"]) == (None, "insufficient_history")
            continue
        design = np.array([[1.0, x[i - 1], x[i - 2]] for i in range(2, t + 1)])
        beta, tail = np.linalg.lstsq(design, np.array(x[2 : t + 1]), rcond=None)[0], x[: t + 1]
        for _ in range(3):
            tail.append(float(beta @ [1.0, tail[-1], tail[-2]]))
        assert r["reason"] is None and r["forecast"] == pytest.approx(tail[-3:], abs=1e-9)
    assert {found["zero", t]["reason"] for t in range(36, 60)} == {"singular_fit"}


def test_histories_that_cannot_be_fitted(spark):
    rng = random.Random(2)
    vector = lambda n=2: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [("gap", i, None if i == 20 else vector()) for i in range(60)]
    rows += [("odd", i, vector(3 if i == 40 else 2)) for i in range(60)] + [("nan", i, [*vector(1), math.nan if i == 40 else rng.random()]) for i in range(60)]
    given = spark.createDataFrame(rows, "key string, month_idx int, v array<double>")
    found = {(r["key"], r["month_idx"]): r["reason"] for r in autoregression.forecasts(given, ["key"], "v", 2, 1, 6, 10).collect()}
    assert found["gap", 19] is None and {found["gap", t] for t in range(20, 30)} == {"insufficient_history"} and found["gap", 30] is None
    assert found["odd", 39] is None and {found["odd", t] for t in range(40, 60)} == {"inconsistent_vector_width"}
    assert found["nan", 39] is None and {found["nan", t] for t in range(40, 60)} == {"non_finite_history"}
    assert autoregression.forecasts(given.limit(0), ["key"], "v", 2, 1, 6, 10).collect() == []


def test_trials_are_replayed_from_snapshots(spark):
    """The same trials whatever the distance of snapshots, and as one stream over all of them draws them."""
    contract = baselines.Contract(trials=60)
    lengths = spark.createDataFrame([(80,), (155,), (80,), (20,)], "length int")
    tables = [sorted(map(tuple, baselines.permutation_tables(lengths, contract, every).collect()), key=str) for every in (7, 250)]
    assert tables[0] == tables[1]
    for n in (80, 155):
        stream = random.Random(contract.seed)
        for trial in range(contract.trials):
            order = baselines.block_permutation(n, contract.block, contract.embargo, stream)
            assert [r[3] for r in sorted(x for x in tables[0] if x[:2] == (n, trial))] == list(order)
    assert [r for r in tables[0] if r[0] == 20] == sorted([(20, t, None, None) for t in range(60)], key=str)  # an embargo that none can meet


def test_permutations_move_everything_far():
    order = baselines.block_permutation(155, 12, 12, random.Random(20260719))
    assert sorted(order) == list(range(155)) and order == baselines.block_permutation(155, 12, 12, random.Random(20260719))
    assert all(min(abs(t - s), 155 - abs(t - s)) > 12 for t, s in enumerate(order))
    assert baselines.block_permutation(20, 12, 12, random.Random(1)) == ()
    with pytest.raises(ValueError):
        baselines.Contract(season=0)


def test_tree_diff(spark):
    left = [(1, '{"a":{"b":1,"c":[1,2]},"d":"x"}'), (2, '{"a":1}')]
    right = [(1, '{"a":{"b":2,"c":"no"},"e":null}'), (2, '{"a":1}')]
    a, b = (compare.flatten_json(spark.createDataFrame(x, "k int, t string"), "k", "t") for x in (left, right))
    got = {(r["path"], r["code"]) for r in compare.tree_diff(a, b, "k").collect()}
    assert got == {("/a/b", "value_mismatch"), ("/a/c", "type_mismatch"), ("/d", "missing_in_candidate"), ("/e", "unexpected_in_candidate")}


def test_unknown_transforms_are_errors(spark):
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([("level", 2.0), ("inverted_level", 2.0), ("yoy_growth", 2.0)], "t string, v double")
    got = {r[0]: r[1] for r in rows.select("t", transforms.level(F.col("t"), F.col("v"))).collect()}
    assert got == {"level": 2.0, "inverted_level": -2.0, "yoy_growth": None}
    own = {**transforms.LEVELS, "doubled": lambda v: v * 2}
    twice = spark.createDataFrame([("doubled", 2.0)], "t string, v double")
    assert twice.select(transforms.level(F.col("t"), F.col("v"), own)).first()[0] == 4.0
    with pytest.raises(PySparkException):
        twice.select(transforms.level(F.col("t"), F.col("v"))).collect()
