"""The frozen store: one canonical JSON line a month, append-only, validated as a whole on every read."""

from __future__ import annotations

import fcntl
import os
import threading
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import calendar, schemas
from tidemark.functions.canonical import canonical_bytes, digest, parse_canonical
from tidemark.functions.values import BANDS
from tidemark.registry import REGISTRY, by_id, registry

SCHEMA_VERSION = "tidemark.frozen.month.v1"
#: What has to be said wherever a series of that licence is used.
NOTICES = {
    "visa_citation": "Uses a spending index that must be cited with its publisher.",
    "umich_internal": "Uses survey values for internal research only.",
}
# The keys of a record and of its parts, as the format has them.
KEYS = {
    "": {
        "assembly_flags", "band", "composite", "families", "finalized_on", "input_vintages", "license_notices", "month",
        "schema_version", "source_assembly_json", "source_assembly_sha256",
    },
    "band": {"candidate_band", "candidate_count", "confirmed_band", "eligible", "published_band", "raw_band", "reference_count", "thresholds"},
    "composite": {"abstained", "headline_tier", "headline_value", "tier_a_value", "tier_b_mapped_band", "tier_b_value"},
}
_LOCKS: dict[str, threading.Lock] = {}
_GUARD = threading.Lock()


@dataclass
class Sequence:
    records: list[dict] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.issues


def _shape(record: dict, month: str, issues: list[tuple[str, str]]) -> None:
    for part, keys in KEYS.items():
        value = record.get(part) if part else record
        if not isinstance(value, dict) or set(value) != keys:
            issues.append((month, f"keys:{part or 'record'}"))
            return
    if record["schema_version"] != SCHEMA_VERSION:
        issues.append((month, "schema_version"))
    band = record["band"]
    for name in ("candidate_band", "confirmed_band", "published_band", "raw_band"):
        if band[name] is not None and band[name] not in BANDS:
            issues.append((month, f"band:{name}"))
    for name in ("candidate_count", "reference_count"):
        if not isinstance(band[name], int) or isinstance(band[name], bool) or band[name] < 0:
            issues.append((month, f"band:{name}"))
    if record["source_assembly_sha256"] != digest(str(record["source_assembly_json"]).encode()):
        issues.append((month, "source_hash"))
    vintages = record["input_vintages"]
    if not isinstance(vintages, dict) or any(str(d) > str(record["finalized_on"]) for d in vintages.values()):
        issues.append((month, "vintage_after_finalization"))
    try:
        if calendar.monthly_finalization_date(month).isoformat() != record["finalized_on"]:
            issues.append((month, "finalization_date"))
    except ValueError:
        issues.append((month, "month"))


def load(path: str | Path) -> Sequence:
    """All records, in order, and whatever is wrong with them; a store that isn't there is empty."""
    found = Sequence()
    if not os.path.exists(path):
        return found
    data = Path(path).read_bytes()
    if data and not data.endswith(b"\n"):
        found.issues.append(("", "no_final_line_feed"))
    previous: dict | None = None
    for number, line in enumerate(data.split(b"\n")[:-1], 1):
        try:
            record = parse_canonical(line + b"\n")
        except (ValueError, TypeError):
            found.issues.append((str(number), "not_canonical"))
            continue
        month = str(record.get("month")) if isinstance(record, dict) else str(number)
        before = len(found.issues)
        _shape(record if isinstance(record, dict) else {}, month, found.issues)
        if len(found.issues) == before:
            if previous and calendar.month_index(month) != calendar.month_index(previous["month"]) + 1:
                found.issues.append((month, "month_gap"))
            if previous and record["finalized_on"] <= previous["finalized_on"]:
                found.issues.append((month, "finalization_order"))
            previous = record
        found.records.append(record)
    return found


@contextmanager
def _locked(path: Path):
    """One writer at a time: among threads by a lock, among processes by one on the folder."""
    with _GUARD:
        lock = _LOCKS.setdefault(str(path.resolve()), threading.Lock())
    with lock:
        path.parent.mkdir(parents=True, exist_ok=True)
        handle = os.open(path.parent, os.O_RDONLY)
        try:
            fcntl.flock(handle, fcntl.LOCK_EX)
            yield
        finally:
            os.close(handle)


def append(path: str | Path, record: dict) -> list[tuple[str, str]]:
    """Append a month to a store that is valid and ends with the month before; what forbids it is returned."""
    target = Path(path)
    with _locked(target):
        now = load(target)
        if not now.ok:
            return now.issues
        issues: list[tuple[str, str]] = []
        _shape(record, str(record.get("month")), issues)
        months = [r["month"] for r in now.records]
        if record.get("month") in months:
            issues.append((record["month"], "month_exists"))
        elif months and not issues and calendar.month_index(record["month"]) != calendar.month_index(months[-1]) + 1:
            issues.append((record["month"], "month_gap"))
        if not issues:
            with target.open("ab") as file:
                file.write(canonical_bytes(record))
                file.flush()
                os.fsync(file.fileno())
        return issues


def refusals(frozen: DataFrame, families: DataFrame) -> DataFrame:
    """(month, code): what forbids to freeze a month.

    The assembly is provisional or isn't the one that finalises the month; it abstains and has values; a family is there
    twice; one series has several vintages, is unknown, or has a licence without a notice.
    """
    spark = frozen.sparkSession
    days = frozen.select("month", "assembly_date", "finalized_on", "abstained", "tier_a", "tier_b", "headline")
    provisional = F.col("provisional") if "provisional" in frozen.columns else F.lit(False)
    valued = F.coalesce("tier_a", "tier_b", "headline").isNotNull()
    rules = {
        "provisional": provisional, "wrong_date": F.col("assembly_date") != F.col("finalized_on"),
        "abstained_with_values": F.col("abstained") & valued, "values_missing": ~F.col("abstained") & ~valued,
    }
    found = frozen.select("month", F.explode(F.array_compact(F.array(*[F.when(r, F.lit(c)) for c, r in rules.items()]))).alias("code"))
    twice = families.groupBy("assembly_date", "family").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = found.unionByName(days.join(twice, "assembly_date").select("month", F.lit("duplicate_family").alias("code")))
    vintages = families.select("assembly_date", F.explode("releases").alias("series_id", "release"))
    several = vintages.groupBy("assembly_date", "series_id").agg(F.count_distinct("release").alias("n")).where("n > 1")
    found = found.unionByName(days.join(several, "assembly_date").select("month", F.lit("vintage_conflict").alias("code")))
    series = registry(spark).select("series_id", "license")
    odd = vintages.join(F.broadcast(series), "series_id", "left").where(F.col("license").isNull() | ~F.col("license").isin("public", *NOTICES))
    return found.unionByName(days.join(odd, "assembly_date").select("month", F.lit("unknown_series").alias("code"))).distinct()


class Refused(ValueError):
    """A month that may not be frozen."""


def source_assembly(day: date, composite: dict, families: list, flags: list[str]) -> str:
    """The canonical JSON of an assembly; transformed values of internal licences are redacted."""
    internal = {s.family for s in REGISTRY if s.license == "umich_internal"}
    members = {
        f["family"]: {
            "abstained": f["abstained"], "flags": list(f["flags"]),
            "member_release_dates": {s: d.isoformat() for s, d in (f["releases"] or {}).items()},
            "transformed_value": None if f["family"] in internal else f["transformed_value"],
            "transformed_value_redacted": f["family"] in internal, "z_score": f["z"],
        }
        for f in families
    }
    return canonical_bytes({"assembly_date": day.isoformat(), "composite": composite, "families": members, "flags": flags}).decode()


def records_from(frozen: DataFrame, families: DataFrame) -> list[dict]:
    """Frozen records of a plan's months (a few hundred rows), with the canonical assembly that each comes from.

    Raises ``Refused`` if any month may not be frozen.
    """
    if wrong := refusals(frozen, families).limit(5).collect():
        raise Refused(f"{[tuple(r) for r in wrong]}")
    by_date: dict[date, list] = {}
    for r in families.select("assembly_date", "family", "z", "abstained", "flags", "releases", "transformed_value").collect():
        by_date.setdefault(r["assembly_date"], []).append(r)
    out = []
    for r in sorted(frozen.collect(), key=lambda r: r["month"]):
        found = by_date.get(r["assembly_date"], [])
        members = {f["family"]: {"abstained": f["abstained"], "flags": list(f["flags"]), "z_score": f["z"]} for f in found}
        inner = {
            "abstained": r["abstained"], "headline_tier": r["headline_tier"], "headline_value": r["headline"],
            "tier_a_value": r["tier_a"], "tier_b_value": r["tier_b"],
        }
        vintages = {s: d.isoformat() for f in found for s, d in (f["releases"] or {}).items()}
        notices = sorted({NOTICES[by_id(s).license] for s in vintages if by_id(s).license in NOTICES})
        source = source_assembly(r["assembly_date"], inner, found, list(r["flags"]))
        cuts = None if r["p70"] is None else {"p70": r["p70"], "p85": r["p85"], "p95": r["p95"]}
        out.append(
            {
                "assembly_flags": list(r["flags"]),
                "band": {
                    "candidate_band": r["candidate_band"], "candidate_count": r["candidate_count"], "confirmed_band": r["confirmed_band"],
                    "eligible": r["eligible"], "published_band": r["published_band"], "raw_band": r["raw_band"],
                    "reference_count": r["reference_count"], "thresholds": cuts,
                },
                "composite": {**inner, "tier_b_mapped_band": r["tier_b_mapped_band"]},
                "families": members, "finalized_on": r["finalized_on"].isoformat(), "input_vintages": vintages,
                "license_notices": notices, "month": r["month"], "schema_version": SCHEMA_VERSION, "source_assembly_json": source,
                "source_assembly_sha256": digest(source.encode()),
            }
        )
    return out


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value) by schema; those that are no such JSON have a null record."""
    return lines.select(F.from_json("value", schemas.FROZEN).alias("r"), "value").select("r.*", F.col("value").alias("line"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A store as a DataFrame, a record a month."""
    return parsed(spark.read.text(path))
