"""Calendar rules, scalar functions, canonical JSON: pinned vectors."""

from datetime import date

import pytest

from tidemark import calendar, registry
from tidemark.functions.canonical import canonical_bytes, parse_canonical, parse_strict


def test_registry_is_complete():
    assert [s.ord for s in registry.REGISTRY] == list(range(1, 11))
    assert registry.by_id("WRMFNS").shift_days == 2 and registry.by_id("DRCCLACBS").tier is None
    with pytest.raises(KeyError):
        registry.by_id("PSAVERT")


@pytest.mark.parametrize(
    ("month", "day"),
    [("2025-01", "2025-03-21"), ("2025-02", "2025-04-21"), ("2024-01", "2024-03-15"), ("2017-02", "2017-04-17"), ("2020-03", "2020-05-15")],
)
def test_finalization(month, day):
    assert calendar.monthly_finalization_date(month).isoformat() == day
    assert calendar.canonical_month_for_assembly(date.fromisoformat(day)) == month


def test_closures_and_assemblies():
    closed = set(calendar.closures())
    assert {date(2015, 4, 3), date(2018, 12, 5), date(2021, 12, 24), date(2022, 6, 20), date(2025, 1, 9), date(2020, 7, 3)} <= closed
    assert date(2022, 1, 1) not in closed and date(2021, 12, 31) not in closed and date(2021, 6, 18) not in closed
    assert calendar.assembly_for_week(date(2015, 4, 3)) == date(2015, 4, 6)
    assert calendar.is_assembly_date(date(2015, 4, 6)) and not calendar.is_assembly_date(date(2015, 4, 3))
    with pytest.raises(ValueError):
        calendar.assembly_for_week(date(2015, 4, 2))
    with pytest.raises(ValueError):
        calendar.is_market_business_day(date(2030, 1, 2))
    for bad in ("2025-13", "2025-1", "202501", "abcd-01"):
        with pytest.raises(ValueError):
            calendar.month_index(bad)


def test_calendar_tables_agree_with_the_rules(spark):
    rows = calendar.assemblies(spark, 2015, 2017).collect()
    assert {r["friday"]: r["assembly_date"] for r in rows} == {r["friday"]: calendar.assembly_for_week(r["friday"]) for r in rows}
    for r in calendar.finalizations(spark, 2015, 2017).where("month_idx > 24180").collect():
        assert calendar.monthly_finalization_date(r["month"]) == r["finalized_on"]


def test_canonical_json():
    value = {"b": 1.2345675, "a": 1.2345665, "negative_zero": -0.0}
    assert canonical_bytes(value) == b'{"a":1.234566,"b":1.234568,"negative_zero":0.000000}\n'
    assert canonical_bytes({"é": [True, None, 3, "x"]}).decode() == '{"é":[true,null,3,"x"]}\n'
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(ValueError):
            parse_strict(bad)
    with pytest.raises(ValueError):
        parse_canonical(b'{"b":1, "a":2}\n')
    with pytest.raises(ValueError):
        canonical_bytes({"a": float("inf")})


def test_column_functions(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import values as V

    rows = spark.createDataFrame([("2020-01-05", "1.5"), ("2020-1-5", " 2"), ("20200105", "."), (None, None), ("2020-02-30", "1e999")], "d string, v string")
    got = rows.select(V.strict_date(F.col("d")), V.number(F.col("v")), V.loose_number(F.col("v"))).collect()
    assert [r[0] for r in got] == [date(2020, 1, 5), None, None, None, None]
    assert [r[1] for r in got] == [1.5, None, None, None, None]
    assert [r[2] for r in got][:4] == [1.5, 2.0, None, None]
    one = spark.range(1)
    assert one.select(V.six_places(F.lit(-0.0000001))).first()[0] == 0.0
    assert one.select(V.clamp(F.lit(None).cast("double"), 3.0)).first()[0] is None
    paths = [("a/b.csv", True), ("/a", False), ("a/../b", False), ("", False), ("a..b", True)]
    frame = spark.createDataFrame(paths, "p string, ok boolean")
    assert all(r[0] == r[1] for r in frame.select(V.safe_path(F.col("p")), "ok").collect())
    bands = [V.classify(F.lit(x), F.lit(70.0), F.lit(85.0), F.lit(95.0)) for x in (69.9, 70.0, 85.0, 95.0, 95.001)]
    assert list(one.select(*bands).first()) == ["Normal", "Watch", "Elevated", "Elevated", "High"]


def test_exact_percentile_at_half_a_quantum(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.values import exact_percentile

    values = [-1_000_000] * 31 + [-100_000, -99_985] + [1_000_000] * 13
    frame = spark.createDataFrame([(sorted(values),), ([5],), ([],)], "x array<bigint>")
    assert [r[0] for r in frame.select(exact_percentile(F.col("x"), 70)).collect()] == [-0.099992, 0.000005, None]
