"""Every registered query against its SQL, on the small tables."""

from pathlib import Path

import pytest

from tidemark.plans import registered

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf, name)}.parquet')")
    return connection


def plain(value):
    if value is None or str(value) in ("<NA>", "NaT", "nan"):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, sf, duck, name):
    got = registered.queries()[name](spark, sf).toPandas()
    want = duck.sql(registered.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(want) > 0
    rows = [sorted(tuple(map(plain, r)) for r in f[columns].astype(object).itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_has_its_sql():
    assert set(registered.queries()) == set(registered.oracle_sql())


def test_the_permutation_null_has_every_trial_of_every_series(spark, sf):
    import random

    from tidemark.operators import baselines
    from tidemark.plans import catalog_scores

    rows = registered.queries()["permutation_null"](spark, sf).collect()
    got = {(r["series"], r["trial"]): r for r in rows}
    scores = {}
    for r in catalog_scores._scores(spark, sf).orderBy("month_idx").collect():
        scores.setdefault(r["series"], []).append((r["signal"], r["outcome_event"]))
    trials = baselines.Contract().trials
    assert trials == 10_000 and len(scores) == 5
    assert len(rows) == len(got) == 5 * trials and {k[0] for k in got} == set(scores)
    for series, points in scores.items():
        stream = random.Random(20260719)
        for trial in range(50):
            order = baselines.block_permutation(len(points), 12, 12, stream)
            episodes = scored = hits = 0
            before = None
            for t, s in enumerate(order):
                signal, event = points[s][0], points[t][1]
                if signal and not before:
                    episodes += 1
                    scored += event is not None
                    hits += bool(event)
                before = signal
            r = got[series, trial]
            assert (r["episodes"], r["scored_episodes"], r["hits"]) == (episodes, scored, hits)
            assert r["lead_rate"] == (hits / scored if scored else None)
