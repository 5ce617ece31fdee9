"""Release files in both modes, from the command line's inputs to a verified assembly."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.cli import _inputs
from tidemark.plans import checker, composite, report
from tidemark.sources import frozen, store

ARCHIVED = "UMICH_SCA_T2N_TOP"


@pytest.fixture(scope="module")
def told(spark, sf, tmp_path_factory):
    """(store, archive): all series but one in a store, that one as releases in a file."""
    folder = tmp_path_factory.mktemp("modes")
    spans = composite.demo_spans(spark, sf).cache()
    s = store.VintageStore(spark, str(folder / "store"))
    stamp = F.lit("2020-01-01").cast("timestamp")
    kept = spans.where(F.col("series_id") != ARCHIVED).withColumns(
        {"source": F.lit("alfred"), "source_file": F.lit(None).cast("string"), "first_fetched_at": stamp, "last_fetched_at": stamp}
    )
    s.upsert_spans(kept)
    s.advance_coverage(kept.select("series_id", F.lit(date(2021, 6, 30)).alias("complete_through"), F.current_timestamp().alias("last_backfill_at")).distinct())
    lines = []
    for r in spans.where(F.col("series_id") == ARCHIVED).orderBy("observation_date", "realtime_start").collect():
        stage = "final" if r["realtime_end"].year == 9999 else "preliminary"
        lines.append(f"{ARCHIVED},{r['observation_date']},{r['value_text']},{r['realtime_start']},{stage},a/x.csv,{r['realtime_start']}T12:00:00Z")
    head = "series_id,observation_date,value_text,release_date,release_stage,source_file,retrieved_at"
    (folder / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    return str(folder / "store"), str(folder / "a.csv")


def test_kinds_of_assemblies_on_both_paths(spark):
    one = {r["assembly_date"]: "provisional" if r["provisional"] else "canonical" for r in composite.modes(spark).collect()}
    other = {r["assembly_date"]: r["kind"] for r in checker.kinds(spark).collect()}
    ends = sorted(one)[0].year, sorted(one)[-1].year  # the months at both ends of the calendar are finalised by days outside of it
    inside = {d for d in one if ends[0] < d.year < ends[1]}
    assert set(one) == set(other) and len(inside) > 500 and all(one[d] == other[d] for d in inside)


def test_release_files_in_both_modes_verify(spark, told):
    root, archive = told
    spans, coverage = _inputs(spark, root, archive)
    assert {r["mode"] for r in spans.select("mode").distinct().collect()} == {None, "canonical", "provisional"}
    final = [r["finalized_on"] for r in calendar.finalizations(spark).where("finalized_on between '2018-09-01' and '2018-11-30'").collect()]
    days = [r["assembly_date"] for r in calendar.assemblies(spark).where("assembly_date between '2018-09-01' and '2018-11-30'").select("assembly_date").distinct().collect()]
    assert final and set(final) < set(days)
    dates = spark.createDataFrame([(d,) for d in days], "assembly_date date")
    families = composite.families(spans, dates, coverage=coverage)
    wrong, label = checker.verify(families, spans, dates, coverage=coverage)
    assert (wrong.count(), label) == (0, "Verified")
    found = families.where("family = 'umich_top_tercile'").collect()
    assert any(r["z"] is not None for r in found) and len(found) == len(days)
    # Without modes every observation is there twice, and the same check finds it.
    assert checker.verify(families, spans.drop("mode"), dates, coverage=coverage)[1] == "Conflicting"


def test_a_sequence_says_what_it_assumes(tmp_path, monkeypatch):
    path = tmp_path / "frozen.jsonl"
    assert not report.assumes_unrevised(None) and not report.assumes_unrevised(str(path))
    path.write_text("x")
    for flags, want in (([], False), (["validation_assumption:umich_unrevised_final"], True)):
        monkeypatch.setattr(frozen, "load", lambda _, f=flags: frozen.Sequence(records=[{"assembly_flags": f}, None]))
        assert report.assumes_unrevised(str(path)) is want
