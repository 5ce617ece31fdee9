"""Sources, stores, plans and the command line, end to end on small data."""

import json
import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions import canonical
from tidemark.functions.canonical import canonical_bytes
from tidemark.operators.baselines import Contract
from tidemark.plans import checker, cleanroom, composite, fixtures, report, validation
from tidemark.sources import archive, files, frozen, http, store

HEADER = "series_id,observation_date,value_text,release_date,release_stage,source_file,retrieved_at"
GOOD = [
    "UMICH_SCA_T2N_TOP,2026-04-01,10.0,2026-05-15,preliminary,a/x.csv,2026-05-20T14:00:00Z",
    "UMICH_SCA_T2N_TOP,2026-04-01,11.0,2026-05-30,final,a/x.csv,2026-05-30T14:00:00Z",
    "UMICH_SCA_T2N_TOP,2026-05-01,20.0,2026-06-15,preliminary,a/x.csv,2026-06-15T14:00:00Z",
    "UMICH_SCA_T2N_TOP,2026-05-01,21.0,2026-06-30,final,a/x.csv,2026-06-30T14:00:00Z",
]


def write(path, lines):
    path.write_text("﻿" + "\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_archive_spans_close_the_day_before(spark, tmp_path):
    found = archive.read_archive(spark, write(tmp_path / "a.csv", GOOD))
    assert found.issues.count() == 0 and found.rows.count() == 4
    both = found.spans(archive.PROVISIONAL).where("observation_date = '2026-04-01'").orderBy("realtime_start").collect()
    assert [(r["realtime_start"], r["realtime_end"]) for r in both] == [
        (date(2026, 5, 20), date(2026, 5, 29)), (date(2026, 5, 30), date(2026, 6, 30)),
    ]
    final = found.spans().where("observation_date = '2026-04-01'").collect()
    assert [(r["realtime_start"], r["realtime_end"]) for r in final] == [(date(2026, 5, 30), date(2026, 6, 30))]


def test_archive_rules(spark, tmp_path):
    swap = lambda line, **k: ",".join(k.get(c, v) for c, v in zip(HEADER.split(","), line.split(",")))
    cases = {
        "unknown_series": swap(GOOD[0], series_id="NOPE"), "unsafe_source_file": swap(GOOD[0], source_file="../x"),
        "unknown_stage": swap(GOOD[0], release_stage="guess"), "stage_not_allowed": swap(GOOD[0], release_stage="revision"),
        "invalid_observation_date": swap(GOOD[0], observation_date="2026-4-1"), "missing_value": swap(GOOD[0], value_text=""),
        "invalid_retrieved_at": swap(GOOD[0], retrieved_at="2026-05-20 14:00"), "extra_value": GOOD[0] + ",more",
        "release_before_observation": swap(GOOD[0], release_date="2026-03-01"), "release_after_retrieval": swap(GOOD[0], release_date="2026-05-21"),
    }
    for code, line in cases.items():
        found = archive.read_archive(spark, write(tmp_path / f"{code}.csv", [line]))
        assert {r["code"] for r in found.issues.collect()} == {code}, code
        assert found.rows.count() == 0
    found = archive.read_archive(spark, write(tmp_path / "order.csv", [GOOD[1], GOOD[0], GOOD[0]]))
    assert {r["code"] for r in found.issues.collect()} == {"not_in_order", "duplicate_row"}
    found = archive.read_archive(spark, write(tmp_path / "conflict.csv", [GOOD[0], GOOD[0].replace("10.0", "12.0")]))
    assert "conflicting_rows" in {r["code"] for r in found.issues.collect()}
    empty = archive.read_archive(spark, write(tmp_path / "empty.csv", []))
    assert {r["code"] for r in empty.issues.collect()} == {"no_rows"}
    (tmp_path / "head.csv").write_text("series_id,value_text,other\nA,1,2\n")
    assert {r["code"] for r in archive.read_archive(spark, str(tmp_path / "head.csv")).issues.collect()} == {"missing_columns", "extra_columns"}
    # Required columns behind fifty others, and a quoted line feed.
    more = [f"m{n}" for n in range(50)]
    wide = [",".join([*more, HEADER]), ",".join([*["x"] * 49, '"two\nlines"', GOOD[0]]), ",".join([*["x"] * 50, GOOD[1]])]
    (tmp_path / "wide.csv").write_text("\n".join(wide) + "\n")
    found = archive.read_archive(spark, str(tmp_path / "wide.csv"))
    assert [(r["line"], r["severity"], r["code"]) for r in found.issues.collect()] == [(1, "warning", "extra_columns")]
    assert sorted(r["line"] for r in found.rows.collect()) == [2, 4]
    # A quarterly series has no monthly gaps.
    assert "gap" not in {r["code"] for r in found.issues.collect()}


def test_the_checker_reads_archives_on_its_own(spark, tmp_path):
    path = write(tmp_path / "a.csv", GOOD)
    for mode, stages in (("canonical", archive.CANONICAL), ("provisional", archive.PROVISIONAL)):
        for assumed in (False, True):
            own, through = checker.archive_spans(spark, [path], mode, assumed)
            first = archive.read_archive(spark, path)
            names = ["series_id", "observation_date", "realtime_start", "realtime_end", "value_text", "release_date"]
            assert sorted(map(tuple, own.select(*names).collect())) == sorted(map(tuple, first.spans(stages, assumed).select(*names).collect()))
            assert sorted(map(tuple, through.collect())) == sorted(map(tuple, first.coverage().collect()))
    cases = {
        checker.EvidenceConflict: [GOOD[0], GOOD[0].replace("10.0", "12.0")],
        checker.EvidenceUnavailable: [GOOD[0].replace("preliminary", "revision")],
    }
    for error, lines in cases.items():
        with pytest.raises(error):
            checker.archive_spans(spark, [write(tmp_path / "b.csv", lines)], "canonical")
    with pytest.raises(checker.EvidenceConflict) as conflict:
        checker.archive_spans(spark, [write(tmp_path / "b.csv", cases[checker.EvidenceConflict]), write(tmp_path / "c.csv", [])], "canonical")
    assert len(conflict.value.debts) == 1
    with pytest.raises(checker.EvidenceUnavailable):
        checker.archive_spans(spark, [path, write(tmp_path / "c.csv", [])], "canonical")


def spans_frame(spark, rows):
    now = datetime(2026, 1, 1)
    full = [(*r, "http", None, now, now) for r in rows]
    from tidemark.schemas import SPANS

    return spark.createDataFrame(full, SPANS)


def test_store(spark, tmp_path):
    s = store.VintageStore(spark, str(tmp_path / "store"))
    rows = [("A", date(2020, 1, 1), date(2020, 2, 1), date(2020, 2, 28), "1"), ("A", date(2020, 1, 1), date(2020, 2, 29), date(9999, 12, 31), "2")]
    assert s.upsert_spans(spans_frame(spark, rows)) == 2
    before = s.snapshot()["observation_spans"]
    assert s.upsert_spans(spans_frame(spark, [(*rows[1][:4], "3")])) == 1
    assert sorted(r["value_text"] for r in before.collect()) == ["1", "2"]
    with pytest.raises(store.VintageCoverageError):
        s.spans_at_vintage("A", date(2020, 2, 15))
    s.mark_backfilled("A", date(2020, 3, 31))
    s.mark_backfilled("A", date(2020, 3, 1))
    assert s.complete_through("A") == date(2020, 3, 31)
    assert [r["value_text"] for r in s.spans_at_vintage("A", date(2020, 2, 28)).collect()] == ["1"]
    assert [r["value_text"] for r in s.spans_at_vintage("A", date(2020, 2, 29)).collect()] == ["3"]
    with pytest.raises(store.VintageCoverageError):
        s.spans_at_vintage("A", date(2020, 4, 1))
    for status in ("failed", "ok"):
        s.record_run(series_id="A", endpoint="observations", status=status, started_at=datetime(2020, 1, 1))
    assert [(r["id"], r["status"]) for r in s.latest_runs().collect()] == [(2, "ok")]
    assert s.integrity_issues().count() == 0 and [r["code"] for r in s.notes().collect()] == []
    assert s.first_fetched("A").count() == 2
    other = s.copy(str(tmp_path / "copy"))
    assert sorted(map(tuple, other.table("observation_spans").collect())) == sorted(map(tuple, s.table("observation_spans").collect()))
    with pytest.raises(ValueError):
        s.copy(str(tmp_path / "copy"))
    levels, issues, vintage = s.outcome_levels(["A"])
    assert vintage == date(2020, 3, 31) and [r["level"] for r in levels.collect()] == [3.0] and issues.count() == 0


def test_a_crashed_write_changes_nothing(spark, tmp_path):
    s = store.VintageStore(spark, str(tmp_path / "store"))
    rows = [("A", date(2020, 1, 1), date(2020, 2, 1), date(9999, 12, 31), "1")]
    s.upsert_spans(spans_frame(spark, rows))
    # A writer that has claimed the next state, and died before it was complete.
    (tmp_path / "store/states/00000002").write_text('{"observation_spans": ')
    assert s.table("observation_spans").count() == 1
    s.PATIENCE = 0.3
    s.upsert_spans(spans_frame(spark, [("B", *rows[0][1:])]))
    assert sorted(r["series_id"] for r in s.table("observation_spans").collect()) == ["A", "B"]
    # Of two writers that start from one state, one is told.
    base = s._base()
    s.mark_backfilled("A", date(2020, 3, 1))
    with pytest.raises(store.ConcurrentWrite):
        s._commit(base, "fetch_runs", s.table("fetch_runs"))
    assert s.complete_through("A") == date(2020, 3, 1)


def test_http_client_pages_and_retries():
    pages = [[{"date": "d", "realtime_start": "a", "realtime_end": "b", "value": str(i)} for i in range(http.PAGE)], [{"date": "d", "realtime_start": "a", "realtime_end": "b", "value": "."}]]
    answers = [(429, b""), (200, json.dumps({"observations": pages[0]}).encode()), (0, b""), (200, json.dumps({"observations": pages[1]}).encode())]
    slept = []
    client = http.Client("http://x", "secret", lambda url: answers.pop(0), slept.append)
    assert len(list(client.rows("observations", "A"))) == http.PAGE + 1
    assert client.rate_limited == 1 and 2.0 in slept and http.PAUSE in slept
    with pytest.raises(http.VintageApiError) as error:
        list(http.Client("http://x", "secret", lambda url: (404, b""), slept.append).rows("observations", "A"))
    assert "secret" not in str(error.value) and "http" not in str(error.value)


def test_fetch_audits_both_endpoints(spark, tmp_path):
    import http.server
    import os

    from tidemark import cli
    from tidemark.registry import by_id

    asked = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            bad = "series_id=RSFHFS" in self.path
            asked.append(self.path)
            slow = len(asked) == 1
            self.send_response(404 if bad else 429 if slow else 200)
            self.end_headers()
            if not bad and not slow:
                rows = {"observations": [{"date": "2020-01-01", "realtime_start": "2020-02-01", "realtime_end": "9999-12-31", "value": "1"}]}
                self.wfile.write(json.dumps({"vintage_dates": ["2020-02-01"]} if "vintagedates" in self.path else rows).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    proxies = {k: os.environ.pop(k) for k in list(os.environ) if k.lower().endswith("_proxy")}
    try:
        from tidemark.sources.http import VintageApi

        spark.dataSource.register(VintageApi)
        s, url = store.VintageStore(spark, str(tmp_path / "store")), f"http://127.0.0.1:{server.server_port}"
        assert cli.fetch_series(s, by_id("RSFSDP"), url, "secret", date(2020, 3, 1))
        assert not cli.fetch_series(s, by_id("RSFHFS"), url, "secret", date(2020, 3, 1))
        assert not cli.fetch_series(s, by_id("RSFSDP"), url, "secret", date(2020, 2, 1))  # before what is covered
    finally:
        server.shutdown()
        os.environ.update(proxies)
    runs = sorted((r["series_id"], r["endpoint"], r["status"]) for r in s.table("fetch_runs").collect())
    assert runs == [
        ("RSFHFS", "vintagedates", "failed"), ("RSFSDP", "observations", "ok"), ("RSFSDP", "vintagedates", "failed"), ("RSFSDP", "vintagedates", "ok"),
    ]
    # How the requests went is evidence: the first one was slowed down, and one series isn't there.
    seen = {(r["series_id"], r["endpoint"], r["status"], r["http_status"], r["rate_limited"]) for r in s.table("fetch_runs").collect()}
    assert {("RSFSDP", "vintagedates", "ok", 200, 1), ("RSFSDP", "observations", "ok", 200, 0), ("RSFHFS", "vintagedates", "failed", 404, 0)} <= seen
    assert len(asked) == 5  # no request was made twice
    assert not any("secret" in (r["error_summary"] or "") or "127.0.0.1" in (r["error_summary"] or "") for r in s.table("fetch_runs").collect())
    assert s.complete_through("RSFSDP") == date(2020, 3, 1) and s.complete_through("RSFHFS") is None
    assert s.provider_health().first()["provider_health"] == "degraded"
    assert ("RSFHFS", "no_coverage") in {(r["series_id"], r["code"]) for r in s.notes().collect()}


def test_http_data_source_plans_a_partition_a_series(spark):
    spark.dataSource.register(http.VintageApi)
    frame = spark.read.format("vintage_api").options(url="http://x", key="k", series="A, B").load()
    assert frame.columns == ["series_id", "observation_date", "realtime_start", "realtime_end", "value_text"]
    assert [p.value for p in http._Reader({"series": "A, B"}).partitions()] == ["A", "B"]


def test_http_data_source_takes_filters_and_tells_of_its_requests(spark):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    reader = http._Filtered({"series": "A, B, C"})
    rest = IsNotNull(("value_text",))
    assert list(reader.pushFilters([In(("series_id",), ("B", "C", "D")), rest])) == [rest] and [p.value for p in reader.partitions()] == ["B", "C"]
    assert list(reader.pushFilters([EqualTo(("series_id",), "C")])) == [] and [p.value for p in reader.partitions()] == ["C"]
    # Nobody listens there: the request's own row says so, and only the series of the filter is asked for.
    spark.dataSource.register(http.VintageApi)
    options = {"url": "http://127.0.0.1:1", "key": "k", "series": "A, B", "audit": "true", "push_filters": "true"}
    found = spark.read.format("vintage_api").options(**options).load().where("series_id = 'B'").collect()
    assert [(r["series_id"], r["requests"], r["http_status"], r["error"]) for r in found] == [("B", 3, 0, "series/observations failed with status 0")]
    client = http.Client("http://x", "k", lambda url: (200, b"<html>"), lambda s: None)
    with pytest.raises(http.VintageApiError):
        list(client.rows("observations", "A"))
    with pytest.raises(http.VintageApiError):
        list(http.Client("http://x", "k", lambda url: (200, b"[]"), lambda s: None).rows("observations", "A"))


@pytest.fixture(scope="module")
def world(spark, sf):
    spans = composite.demo_spans(spark, sf).cache()
    weekly, months, _ = validation.reconstruct(spans, "2018-10", "2021-07", burn_in=12)
    months = months.cache()
    dates = months.select("assembly_date")
    families = composite.families(spans, dates).cache()
    return spans, months, dates, families


def test_second_path_agrees(spark, world):
    spans, _, dates, families = world
    wrong, label = checker.verify(families, spans, dates)
    assert (wrong.count(), label) == (0, "Verified")
    assert families.where("z is not null").count() > 100


@pytest.mark.parametrize("rules", [{"ddof": 1}, {"staleness": {"VISASMIDSA": -1}}])
def test_seeded_faults_are_found(spark, world, rules):
    spans, _, dates, families = world
    assert checker.verify(families, spans, dates, checker.Rules(**rules))[1] == "Conflicting"


def test_changed_rules_never_verify(spark, world):
    spans, _, dates, families = world
    again = checker.Rules(staleness={"VISASMIDSA": 40})
    assert checker.verify(families, spans, dates, again)[1] == "Provisional"
    assert checker.verify(families.limit(0), spans, dates.limit(0))[1] == "Unverified"
    assert all(checker.Rules(**{k: v}).changed for k, v in {"burn_in": 5, "dwell": 3, "include_current": True, "ddof": 1}.items())
    assert checker.verify(families, spans, dates, debts=("an open one",))[1] == "Provisional"


def forged(spark, records, change):
    """The records as read, after a change to the eleventh."""
    found = json.loads(json.dumps(records))
    change(found[10])
    return frozen.parsed(spark.createDataFrame([(canonical_bytes(r).decode(),) for r in found], "value string"))


def test_frozen_sequence_is_verified(spark, world):
    spans, months, _, families = world
    records = frozen.records_from(months, families)
    rules = checker.Rules(burn_in=12)
    wrong, label = checker.verify_sequence(forged(spark, records, lambda r: None), spans, rules)
    assert (wrong.count(), label) == (0, "Provisional")  # twelve months of burn-in are changed rules
    month = records[10]["month"]

    def redaction(r):
        source = json.loads(r["source_assembly_json"])
        source["families"]["umich_top_tercile"]["transformed_value"] = 1.0
        r["source_assembly_json"] = canonical_bytes(source).decode()
        r["source_assembly_sha256"] = canonical.digest(r["source_assembly_json"].encode())

    cases = {
        "finalized_on": lambda r: r.update(finalized_on="2019-10-19"), "redaction": redaction,
        "license_notices": lambda r: r.update(license_notices=[]), "band.reference_count": lambda r: r["band"].update(reference_count=1),
        "source_hash": lambda r: r.update(source_assembly_json=r["source_assembly_json"].replace("{", "{ ", 1)),
        "arithmetic.abstained": lambda r: r["composite"].update(abstained=not r["composite"]["abstained"]),
        "vintages": lambda r: r["input_vintages"].update(REVOLSL="2050-01-01"), "family_set": lambda r: r["families"].pop("strain"),
    }
    for check, change in cases.items():
        wrong, label = checker.verify_sequence(forged(spark, records, change), None, rules)
        found = {(r["month"], r["check"]) for r in wrong.collect()}
        assert (month, check) in found and label == "Conflicting", (check, found)
        assert {m for m, _ in found} == {month}
    odd = [canonical_bytes(records[0]).decode(), '{"month":"2019-01","month":"2019-02"}', "no json", '{"month":"2019-03"}']
    odd.append(canonical_bytes({**records[1], "composite": {**records[1]["composite"], "tier_a_value": 1}}).decode())
    found = {tuple(r) for r in checker.shapes(spark.createDataFrame([(x,) for x in odd], "line string")).collect()}
    assert {c for _, c in found} >= {"repeated_key", "no_json", "keys.record", "type.composite.tier_a_value"}
    assert not any(m == records[0]["month"] for m, _ in found)
    wrong, _ = checker.verify_sequence(forged(spark, records[:20] + records[21:], lambda r: None), None, rules)
    assert "month_gap" in {r["check"] for r in wrong.collect()}


@pytest.mark.parametrize("rules", [{"include_current": True}, {"dwell": 3}, {"burn_in": 14}])
def test_seeded_band_faults_are_found(spark, world, rules):
    _, months, _, families = world
    records = frozen.records_from(months, families)
    wrong, label = checker.verify_sequence(forged(spark, records, lambda r: None), None, checker.Rules(**{"burn_in": 12, **rules}))
    assert label == "Conflicting" and all(r["check"].startswith(("band.", "tier_b_mapped")) for r in wrong.collect())


def test_months_that_may_not_be_frozen(spark, world):
    _, months, _, families = world
    odd = months.withColumn("assembly_date", F.date_add("assembly_date", (F.col("month") == "2019-01").cast("int")))
    odd = odd.withColumn("abstained", F.col("abstained") | (F.col("month") == "2020-12"))
    twice = families.unionByName(families.where("assembly_date = '2020-08-21' and family = 'strain'"))
    found = {(r["month"], r["code"]) for r in frozen.refusals(odd, twice).collect()}
    assert found == {("2019-01", "wrong_date"), ("2020-12", "abstained_with_values"), ("2020-06", "duplicate_family")}
    with pytest.raises(frozen.Refused):
        frozen.records_from(odd, twice)


def test_frozen_bands_equal_the_state_machine(world):
    _, months, _, _ = world
    rows = sorted(months.collect(), key=lambda r: r["month"])
    twin = checker.replay_bands([r["tier_a"] for r in rows], checker.Rules(burn_in=12))
    for r, t in zip(rows, twin):
        cuts = t.pop("thresholds")
        assert {k: r[k] for k in t} == t and (cuts or (None, None, None)) == (r["p70"], r["p85"], r["p95"])


def test_store_is_append_only(world, tmp_path):
    _, months, _, families = world
    records = frozen.records_from(months, families)
    path = tmp_path / "f.jsonl"
    assert frozen.append(path, records[0]) == [] and frozen.append(path, records[1]) == []
    assert frozen.append(path, records[1]) == [(records[1]["month"], "month_exists")]
    assert frozen.append(path, records[4]) == [(records[4]["month"], "month_gap")]
    results = []
    threads = [threading.Thread(target=lambda: results.append(frozen.append(path, records[2]))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(len, results)) == [0, 1, 1, 1] and len(frozen.load(path).records) == 3
    path.write_bytes(path.read_bytes().replace(b'"abstained":false', b'"abstained": false', 1))
    assert frozen.append(path, records[3]) and not frozen.load(path).ok


def test_validation_artifact(spark, world, tmp_path, sf):
    spans, _, _, _ = world
    path = str(tmp_path / "frozen.jsonl")
    assert validation.reconstruct_store(spans, path, "2018-10", "2021-07", burn_in=12) == 34
    assert frozen.read(spark, path).where("month is not null and band is not null").count() == 34
    levels = fixtures.quarterly(spark, sf)
    from tidemark.operators.outcomes import outcome_gaps, trend_gap

    gaps = trend_gap(levels, ["component"])
    gaps = outcome_gaps(gaps.where("component = 'F'"), gaps.where("component = 'O'"))
    contract = Contract(trials=20, block=4, embargo=4, minimum=12, ar_lags=2)
    out = str(tmp_path / "artifact.json")
    first = validation.run(spark, path, gaps, contract, date(2021, 12, 31), "Verified", out)
    assert validation.run(spark, path, gaps, contract, date(2021, 12, 31), "Verified", out) == first
    found = json.loads((tmp_path / "artifact.json").read_text())
    assert {f["model"] for f in found["baseline_floor"]} == {"seasonal_naive", "ar", "var"}
    assert len(found["calibration"]["rows"]) == 4 and found["primary_summary"]["points"] == 34
    assert found["framing"]["leading_claim_allowed"] is False and found["source"]["checker_label"] == "Verified"
    assert found["power"]["episodes"] == found["primary_summary"]["episodes"] and found["verification_debt"]
    with pytest.raises(validation.ValidationError):
        validation.run(spark, path, gaps, contract, date(2021, 12, 31), "Provisional", out)
    records = frozen.load(path).records
    unmet = validation.gates(records, gaps.limit(0), "xyz", date(2021, 12, 31), "Verified", 0, False)
    assert len(unmet) == 4 and validation.gates(records, gaps, "0" * 64, date(2021, 12, 31), "Verified", 1, True) == []


def test_weekly_report(spark, world, tmp_path):
    spans, months, _, families = world
    day = calendar.monthly_finalization_date("2020-12")
    store_path = tmp_path / "frozen.jsonl"
    store_path.write_bytes(b"".join(map(canonical_bytes, frozen.records_from(months, families))))
    live = report.live_sequence(spark, str(store_path), None)
    assert live.latest["month"] == "2021-07" and live.confidence == "Conflicting"  # it was frozen with other rules
    live = report.Live(live.sha256, {**live.latest, "band": {**live.latest["band"], "published_band": "Watch"}}, "Verified")
    artifact = {
        "schema_version": validation.SCHEMA_VERSION, "baseline_floor": [], "calibration": {"monotonic": True, "rows": []}, "primary_summary": {},
        "framing": {"claim_status": "descriptive_only", "leading_claim_allowed": False, "monitor_status": "coincident_monitor", "research_label": "research_only"},
        "source": {"checker_label": "Verified", "frozen_sha256": "0" * 64, "outcome_vintage": "2021-12-31"}, "verification_debt": ["few_episodes"],
    }
    (tmp_path / "artifact.json").write_bytes(canonical_bytes(artifact))
    common = {"live": live, "validation_path": str(tmp_path / "artifact.json")}
    one = report.weekly(spark, spans, day, str(tmp_path / "a"), **common)
    two = report.weekly(spark, spans, day, str(tmp_path / "b"), previous=str(tmp_path / "a/report.json"), **common)
    assert one["confidence"] == "Verified" and two["changes"] == [] and two["previous_run_id"] == one["run_id"]
    by_id = {f["finding_id"]: f for f in one["findings"]}
    hidden = by_id["family:umich_top_tercile"]["values"]
    assert hidden["transformed_value"] is None and hidden["transformed_value_redacted"]
    assert not by_id["family:visa_smi"]["values"]["transformed_value_redacted"] and by_id["sequence"]["label"] == "watchlist"
    met = {c["condition_id"]: c["met"] for c in one["launch_audit"]["conditions"]}
    assert len(met) == 9 and met["current_assembly_verified"] and met["live_history_available"] and not met["leading_claim_allowed"]
    assert not one["launch_audit"]["external_ready"] and one["launch_audit"]["internal_ready"]
    assert one["debts"] == [{"debt_id": "few_episodes", "scope": "validation"}]
    assert len(report.cited(one["findings"], one["evidence"])) >= 11
    with pytest.raises(report.ReportError):
        report.cited([{"finding_id": "x", "evidence_ids": ["none"]}], one["evidence"])
    with pytest.raises(report.ReportError):
        report.weekly(spark, spans, day, str(tmp_path / "a"), previous=str(tmp_path / "a/report.json"))
    assert (tmp_path / "a/assembly.json").read_bytes() == (tmp_path / "b/assembly.json").read_bytes()
    assert "| sequence | watchlist |" in (tmp_path / "a/report.md").read_text()
    cold = report.live_sequence(spark, str(tmp_path / "nowhere"), None)
    assert cold.latest is None and cold.confidence == "Unverified"


def test_cleanroom(world, tmp_path):
    _, months, _, families = world
    records = frozen.records_from(months, families)[:3]
    start, end = records[0]["month"], records[-1]["month"]
    reference, mine = tmp_path / "ref.jsonl", tmp_path / "mine.jsonl"
    reference.write_bytes(b"".join(map(canonical_bytes, records)))
    mine.write_bytes(b"".join(canonical_bytes(cleanroom.project(r)) for r in records))
    (tmp_path / "input.csv").write_text("x\n")
    packet = str(tmp_path / "packet")
    cleanroom.prepare({"input.csv": str(tmp_path / "input.csv")}, packet, start, end, "2026-01-01T00:00:00Z")
    attested = dict.fromkeys(cleanroom.ATTESTATIONS, True)
    with pytest.raises(cleanroom.CleanRoomError):
        cleanroom.seal(packet, str(mine), "other", attested, "2025-01-01T00:00:00Z", "2026-01-03T00:00:00Z", str(tmp_path / "s0"))
    cleanroom.seal(packet, str(mine), "other", attested, "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z", str(tmp_path / "seal"))
    found = cleanroom.compare(packet, str(reference), str(mine), str(tmp_path / "seal"), str(tmp_path / "cmp"))
    assert found["verdict"] == "exact_match" and not found["debt_closed"]
    (tmp_path / "artifact.json").write_bytes(canonical_bytes({"source": {"checker_label": "Verified", "frozen_sha256": "0" * 64}}))
    with pytest.raises(cleanroom.CleanRoomError):
        cleanroom.compare(packet, str(reference), str(mine), str(tmp_path / "seal"), str(tmp_path / "cmp2"), str(tmp_path / "artifact.json"))
    assert set(cleanroom.project(records[0])["input_vintages"]) == set(cleanroom.SERIES) and len(cleanroom.SERIES) == 5
    changed = json.loads(json.dumps(cleanroom.project(records[1])))
    changed["tier_a_value"] = 9.0
    assert cleanroom.differences([cleanroom.project(records[1])], [changed])[0] == 1
    (tmp_path / "packet/extra").write_text("x")
    with pytest.raises(cleanroom.CleanRoomError):
        cleanroom.verify_packet(packet)
    (tmp_path / "link").symlink_to(tmp_path / "input.csv")
    with pytest.raises(files.EvidenceError):
        files.read_regular(tmp_path / "link")
    with pytest.raises(files.EvidenceError):
        files.write_once(tmp_path / "input.csv", b"other")


def test_command_line(tmp_path, capsys):
    from tidemark.cli import main

    assert main(["validate", "--store", "x", "--frozen", "f", "--output", "o", "--start", "2020-01", "--end", "2020-02"]) == 2
    assert main(["report", "--store", "x", "--date", "2020-01-01", "--output", "o"]) == 2
    assert main(["fetch", "--store", "x", "--url", "http://x", "--key-variable", "NO_SUCH_VARIABLE"]) == 2
    (tmp_path / "a").write_text("x")
    made = ["cleanroom-prepare", "--file", f"aaa={tmp_path}/a", "--output", f"{tmp_path}/p", "--start", "2020-01", "--end", "2020-02", "--at", "2026-01-01T00:00:00Z"]
    assert main(made) == 0 and main(made) == 2


def test_entry_and_queries(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "composite_all_assemblies" in names
    frame = names["composite_frozen_months"](spark, sf)
    assert frame.where(F.col("tier_a").isNotNull()).count() > 20
