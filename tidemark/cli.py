"""Command line: fetch, validate, report, and the three clean-room steps. Exit codes: 0 fine, 1 failed, 2 refused."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import date, datetime, timezone

from tidemark.session import get_spark


def _fetch(args) -> int:
    """Both endpoints of each series, pinned to one cutoff; each is a run of its own in the store's audit."""
    from tidemark.config import Config, ConfigError
    from tidemark.registry import REGISTRY, by_id
    from tidemark.sources.http import VintageApi
    from tidemark.sources.store import VintageStore

    config = Config.of(args.root, args.key_variable)
    try:
        config.check_fetch()
        chosen = [by_id(s) for s in args.series] if args.series else [s for s in REGISTRY if s.source != "archive"]
    except (ConfigError, KeyError) as error:
        print(error, file=sys.stderr)
        return 2
    spark = get_spark("tidemark fetch")
    spark.dataSource.register(VintageApi)
    store, cutoff, failed = VintageStore(spark, args.store or config.store), args.cutoff or date.today(), 0
    for series in chosen:
        failed += not fetch_series(store, series, args.url, config.key, cutoff)
    return 1 if failed else 0


def fetch_series(store, series, url: str, key: str, cutoff: date) -> bool:
    """Fetch one series through the data source, first its vintage dates, then its observations up to the same cutoff."""
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    spark = store.spark

    def audited(endpoint: str, work) -> bool:
        run = {"started_at": datetime.now(timezone.utc), "series_id": series.series_id, "endpoint": endpoint}
        told: dict = {"rate_limited": 0, "http_status": None}
        rows = None
        try:
            options = {"url": url, "key": key, "series": series.series_id, "endpoint": endpoint, "realtime_end": cutoff.isoformat(), "audit": "true"}
            # Kept, as the requests' own row and the data come from one reading; a lost block would only be asked for anew.
            rows = spark.read.format("vintage_api").options(**options).load().persist()
            asked = rows.where("requests is not null").select("rate_limited", "http_status", "error").first()
            told = {"rate_limited": asked["rate_limited"], "http_status": asked["http_status"]}
            if asked["error"]:
                raise ValueError(f"VintageApiError: {asked['error']}")
            known = work(rows.where("requests is null").drop("requests", "rate_limited", "http_status", "error"))
        except (PySparkException, ValueError) as error:
            # The message has neither URL nor key.
            said = [x for x in str(error).replace(key, "***").splitlines() if "Error" in x and "http" not in x] or [type(error).__name__]
            store.record_run(**run, **told, completed_at=datetime.now(timezone.utc), status="failed", error_summary=said[-1][:200])
            return False
        finally:
            if rows is not None:
                rows.unpersist()
        store.record_run(**run, **told, completed_at=datetime.now(timezone.utc), status="ok", rows_upserted=known)
        return True

    def vintages(rows) -> int:
        known = store.complete_through(series.series_id)
        if known and cutoff < known:
            raise ValueError("ValueError: the cutoff is before what is covered")
        dates = rows.select("series_id", F.to_date("vintage_date").alias("vintage_date"), F.current_timestamp().alias("fetched_at")).cache()
        last = dates.agg(F.max("vintage_date")).first()[0]
        if last is None or last > cutoff:
            raise ValueError("ValueError: no vintages, or some after the cutoff")
        return store.insert_vintages(dates)

    def observations(rows) -> int:
        spans = rows.select(
            "series_id", *[F.to_date(c).alias(c) for c in ("observation_date", "realtime_start", "realtime_end")], "value_text",
            F.lit(series.source).alias("source"), F.lit(None).cast("string").alias("source_file"),
            F.current_timestamp().alias("first_fetched_at"), F.current_timestamp().alias("last_fetched_at"),
        ).cache()
        return store.upsert_spans(spans)

    fine = audited("vintagedates", vintages) and audited("observations", observations)
    if fine:
        store.mark_backfilled(series.series_id, cutoff)
    return fine


def _inputs(spark, root: str, paths, assume_unrevised=False):
    """(spans, coverage) of a store and of release files; a file with errors is refused as a whole.

    Release files give two sets of spans: final ones for assemblies that finalise a month, and those with preliminary
    releases for the weeks between.
    """
    from pyspark.sql import functions as F

    from tidemark.operators.pit import BASES
    from tidemark.sources.archive import CANONICAL, PROVISIONAL, read_archive
    from tidemark.sources.store import VintageStore

    tables = VintageStore(spark, root).snapshot()
    columns = ["series_id", "observation_date", "realtime_start", "realtime_end", "value_text", "source"]
    spans = tables["observation_spans"].select(*columns).withColumn("availability_basis", F.lit(BASES[0]))
    coverage = tables["series_coverage"].select("series_id", "complete_through")
    if not paths:
        return spans, coverage
    found = read_archive(spark, paths)
    wrong = found.issues.where("severity = 'error'").select("file", "line", "code").limit(5).collect()
    if wrong:
        raise SystemExit(f"the archive has errors: {[tuple(r) for r in wrong]}")
    basis = BASES[1] if assume_unrevised else BASES[0]
    for stages, mode in ((CANONICAL, "canonical"), (PROVISIONAL, "provisional")):
        more = found.spans(stages, assume_unrevised).select(*columns[:5], "release_date", "release_stage", "retrieved_at")
        more = more.withColumns({"source": F.lit("archive"), "availability_basis": F.lit(basis), "mode": F.lit(mode)})
        spans = spans.unionByName(more, allowMissingColumns=True)
    return spans, coverage.unionByName(found.coverage())


def _validate(args) -> int:
    from pyspark.sql import functions as F

    from tidemark.operators.baselines import Contract
    from tidemark.operators.outcomes import outcome_gaps, trend_gap
    from tidemark.plans import checker, validation
    from tidemark.sources import frozen
    from tidemark.sources.store import VintageStore

    if not args.approved:
        print("the contract isn't approved", file=sys.stderr)
        return 2
    spark = get_spark("tidemark validate")
    spans, coverage = _inputs(spark, args.store, args.archive, assume_unrevised=True)
    try:
        validation.reconstruct_store(spans, args.frozen, args.start, args.end, coverage=coverage, weekly_path=args.weekly)
        # The file itself is verified, against itself and against sources that the checker reads on its own.
        own, known = VintageStore(spark, args.store).snapshot()["observation_spans"].select(*spans.columns[:5]), coverage
        if args.archive:
            more, _ = checker.archive_spans(spark, args.archive, "canonical", assume_unrevised=True)
            own = own.unionByName(more, allowMissingColumns=True)
        wrong, label = checker.verify_sequence(frozen.read(spark, args.frozen), own, coverage=known)
        for row in wrong.limit(5).collect():
            print(f"{row['month']}: {row['check']}", file=sys.stderr)
        levels, issues, vintage = VintageStore(spark, args.store).outcome_levels(["DRCARX1Q020SBEA", "DFSARX1Q020SBEA"])
        if issues.where("code <> 'missing_level'").count():
            return 1
        gaps = trend_gap(levels, ["series_id"])
        both = outcome_gaps(gaps.where(F.col("series_id") == "DRCARX1Q020SBEA"), gaps.where(F.col("series_id") == "DFSARX1Q020SBEA"))
        print(json.dumps(validation.run(spark, args.frozen, both, Contract(), vintage, label, args.output), sort_keys=True))
    except (validation.ValidationError, frozen.Refused, checker.EvidenceUnavailable, checker.EvidenceConflict, LookupError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


def _report(args) -> int:
    from tidemark import calendar
    from tidemark.plans import report
    from tidemark.sources.store import VintageStore

    if not calendar.is_assembly_date(args.date):
        print("that day has no assembly", file=sys.stderr)
        return 2
    spark = get_spark("tidemark report")
    spans, coverage = _inputs(spark, args.store, args.archive)
    store = VintageStore(spark, args.store)
    health = store.provider_health().first()
    operations = {"notes": sorted((r.asDict() for r in store.notes().collect()), key=str), **health.asDict()}
    # A sequence that was frozen under an assumption is verified under it; the report itself makes none.
    assumed = bool(args.archive) and report.assumes_unrevised(args.frozen)
    frozen_spans = _inputs(spark, args.store, args.archive, assume_unrevised=True)[0] if assumed else spans
    try:
        live = report.live_sequence(spark, args.frozen, frozen_spans, coverage)
        found = report.weekly(
            spark, spans, args.date, args.output, live=live, validation_path=args.validation, previous=args.previous, coverage=coverage, operations=operations
        )
    except report.ReportError as error:
        print(error, file=sys.stderr)
        return 2
    print(found["run_id"])
    return 0 if found["confidence"] in ("Verified", "Provisional") else 1


def _cleanroom(args) -> int:
    from tidemark.plans import cleanroom

    try:
        if args.command == "cleanroom-prepare":
            made = cleanroom.prepare(dict(s.split("=", 1) for s in args.file), args.output, args.start, args.end, args.at)
        elif args.command == "cleanroom-seal":
            attested = dict.fromkeys(args.attest, True)
            made = cleanroom.seal(args.packet, args.candidate, args.implementation, attested, args.submitted, args.at, args.output)
        else:
            made = cleanroom.compare(args.packet, args.reference, args.candidate, args.seal, args.output, args.artifact)
    except (cleanroom.CleanRoomError, OSError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 2
    print(json.dumps({"schema_version": made["schema_version"]}))
    return 1 if made.get("verdict") == "different" else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    fetch = sub.add_parser("fetch")
    fetch.add_argument("--url", required=True)
    fetch.add_argument("--key-variable", default="VINTAGE_API_KEY")
    fetch.add_argument("--root", default=".")
    fetch.add_argument("--series", nargs="*")
    fetch.add_argument("--cutoff", type=date.fromisoformat)
    validate = sub.add_parser("validate")
    for name in ("--frozen", "--output", "--start", "--end"):
        validate.add_argument(name, required=True)
    validate.add_argument("--approved", action="store_true")
    validate.add_argument("--weekly", help="where the weekly assemblies go, as Parquet")
    report = sub.add_parser("report")
    report.add_argument("--date", type=date.fromisoformat, required=True)
    report.add_argument("--output", required=True)
    for name in ("--previous", "--frozen", "--validation"):
        report.add_argument(name)
    for p in (validate, report):
        p.add_argument("--store", required=True)
    fetch.add_argument("--store", help="the store's folder; below --root if not given")
    for p in (validate, report):
        p.add_argument("--archive", nargs="*", default=[])
    prepare = sub.add_parser("cleanroom-prepare")
    prepare.add_argument("--file", action="append", default=[], metavar="NAME=PATH")
    for name in ("--output", "--start", "--end", "--at"):
        prepare.add_argument(name, required=True)
    sealer = sub.add_parser("cleanroom-seal")
    for name in ("--packet", "--candidate", "--implementation", "--submitted", "--at", "--output"):
        sealer.add_argument(name, required=True)
    sealer.add_argument("--attest", nargs="*", default=[])
    compare = sub.add_parser("cleanroom-compare")
    for name in ("--packet", "--reference", "--candidate", "--seal", "--output"):
        compare.add_argument(name, required=True)
    compare.add_argument("--artifact", help="the validation that vouches for the reference")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    action = {"fetch": _fetch, "validate": _validate, "report": _report}.get(args.command, _cleanroom)
    return action(args)


if __name__ == "__main__":
    sys.exit(main())
