"""Blind reproduction: an immutable packet out, a sealed submission in, a comparison of both."""

from __future__ import annotations

import os
import re
import stat
from datetime import datetime
from pathlib import Path

from tidemark import calendar
from tidemark.functions.canonical import canonical_bytes, digest, parse_canonical
from tidemark.operators.compare import flatten
from tidemark.operators.compose import ASSUMPTION
from tidemark.registry import REGISTRY
from tidemark.sources import files

PACKET, SEAL, COMPARISON = "tidemark.cleanroom.packet.v1", "tidemark.cleanroom.seal.v1", "tidemark.cleanroom.comparison.v1"
FAMILIES = ("census_retail", "household_liquidity", "umich_top_tercile")
MOST_EXAMPLES = 100
ATTESTATIONS = ("independent_implementation", "no_reference_access")
_ID = re.compile(r"^[a-z0-9][a-z0-9._-]{2,63}$")
_SHA256 = re.compile(r"^[0-9a-f]{64}$")
#: Series whose vintages both sides must have used.
SERIES = tuple(s.series_id for s in REGISTRY if s.family in FAMILIES)


class CleanRoomError(RuntimeError):
    """A packet, submission or seal isn't what it must be."""


def _months(start: str, end: str) -> list[str]:
    low, high = calendar.month_index(start), calendar.month_index(end)
    if high < low:
        raise CleanRoomError("the window is empty")
    return [f"{i // 12:04d}-{i % 12 + 1:02d}" for i in range(low, high + 1)]


def prepare(sources: dict[str, str], output: str, start: str, end: str, generated_at: str) -> dict:
    """Copy regular files into a new private folder with a manifest of their sizes and hashes; nothing is replaced."""
    target = Path(output)
    if os.path.lexists(target):
        raise CleanRoomError("the packet exists")
    months = _months(start, end)
    work = target.with_name(f".{target.name}.part")
    work.mkdir(mode=0o700, parents=True)
    items = []
    for name in sorted(sources):
        if not _ID.match(name):
            raise CleanRoomError(f"{name!r} is no packet name")
        data = files.read_regular(sources[name], 1 << 30)
        files.replace(work / name, data)
        items.append({"bytes": len(data), "path": name, "sha256": digest(data)})
    manifest = {"files": items, "generated_at": generated_at, "months": {"count": len(months), "end": end, "start": start}, "schema_version": PACKET}
    files.replace(work / "manifest.json", canonical_bytes(manifest))
    os.replace(work, target)
    return manifest


def verify_packet(folder: str) -> dict:
    """The manifest of a packet that holds exactly its files, private and unchanged."""
    root = Path(folder)
    manifest = parse_canonical(files.read_regular(root / "manifest.json"))
    if manifest["schema_version"] != PACKET:
        raise CleanRoomError("this is no packet")
    wanted = {f["path"] for f in manifest["files"]} | {"manifest.json"}
    there = {p.name for p in root.iterdir()}
    if there != wanted:
        raise CleanRoomError(f"files differ: {sorted(there ^ wanted)}")
    for name in there:
        mode = os.lstat(root / name).st_mode
        if not stat.S_ISREG(mode) or stat.S_IMODE(mode) & 0o077:
            raise CleanRoomError(f"{name} isn't a private regular file")
    for f in manifest["files"]:
        if files.describe(root / f["path"], f["path"]) != f:
            raise CleanRoomError(f"{f['path']} changed")
    return manifest


def project(record: dict) -> dict:
    """What both sides of a comparison have of a month."""
    families = record["families"]
    return {
        "band": record["band"],
        "families": {f: {k: families[f][k] for k in ("abstained", "flags", "z_score")} for f in FAMILIES if f in families},
        "finalized_on": record["finalized_on"],
        "input_vintages": {s: record["input_vintages"].get(s) for s in SERIES},
        "month": record["month"],
        "tier_a_abstained": record["composite"]["tier_a_value"] is None,
        "tier_a_value": record["composite"]["tier_a_value"],
        "unrevised_final_assumption": ASSUMPTION in record["assembly_flags"],
    }


def sequence(path: str, start: str, end: str) -> list[dict]:
    """A canonical JSONL sequence of exactly the months of a window."""
    data = files.read_regular(path)
    if b"\r" in data or not data.endswith(b"\n"):
        raise CleanRoomError("lines must end with a line feed alone")
    records = []
    for line in data.split(b"\n")[:-1]:
        try:
            records.append(parse_canonical(line + b"\n"))
        except (ValueError, TypeError) as error:
            raise CleanRoomError("a line isn't canonical") from error
    if [r.get("month") for r in records] != _months(start, end):
        raise CleanRoomError("the months aren't those of the window")
    return records


def _instant(text: str) -> datetime:
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", text):
        raise CleanRoomError(f"{text!r} is no UTC instant")
    return datetime.fromisoformat(text)


def seal(packet: str, candidate: str, implementation: str, attested: dict[str, bool], submitted_at: str, sealed_at: str, output: str) -> dict:
    """Bind a candidate to a packet before anything is compared. Times must follow each other, all must be attested."""
    manifest = verify_packet(packet)
    if not _ID.match(implementation):
        raise CleanRoomError("the implementation has no valid name")
    if sorted(attested) != sorted(ATTESTATIONS) or not all(attested.values()):
        raise CleanRoomError("not everything is attested")
    if not _instant(manifest["generated_at"]) < _instant(submitted_at) < _instant(sealed_at):
        raise CleanRoomError("times are out of order")
    sequence(candidate, manifest["months"]["start"], manifest["months"]["end"])
    value = {
        "attested": attested, "candidate_sha256": digest(files.read_regular(candidate)), "implementation": implementation,
        "manifest_sha256": digest(files.read_regular(Path(packet) / "manifest.json")), "schema_version": SEAL,
        "sealed_at": sealed_at, "submitted_at": submitted_at,
    }
    files.write_once(output, canonical_bytes(value))
    return value


def load_seal(path: str) -> dict:
    """A seal of exactly its parts, with hashes, names and instants of the right shape."""
    value = parse_canonical(files.read_regular(path))
    keys = {"attested", "candidate_sha256", "implementation", "manifest_sha256", "schema_version", "sealed_at", "submitted_at"}
    if not isinstance(value, dict) or set(value) != keys or value["schema_version"] != SEAL:
        raise CleanRoomError("this is no seal")
    if not all(_SHA256.match(str(value[k])) for k in ("candidate_sha256", "manifest_sha256")) or not _ID.match(str(value["implementation"])):
        raise CleanRoomError("the seal's hashes or name have no valid shape")
    _instant(str(value["submitted_at"])), _instant(str(value["sealed_at"]))
    return value


def check_reference(reference: str, artifact: str) -> str:
    """The hash of a reference sequence, if a validation artifact vouches for exactly its bytes as verified."""
    sha256 = digest(files.read_regular(reference))
    source = parse_canonical(files.read_regular(artifact)).get("source", {})
    if source.get("frozen_sha256") != sha256 or source.get("checker_label") != "Verified":
        raise CleanRoomError("no verified validation vouches for the reference")
    return sha256


def differences(reference: list[dict], candidate: list[dict]) -> tuple[int, list[dict]]:
    """All differences of two sequences counted, the first hundred shown, by JSON pointer."""
    count, examples = 0, []
    for a, b in zip(reference, candidate):
        left, right = ({p: (k, v) for p, k, v in flatten(x)} for x in (a, b))
        gone: list[str] = []
        for path in sorted(left.keys() | right.keys()):
            if any(path.startswith(f"{g}/") for g in gone):
                continue
            x, y = left.get(path), right.get(path)
            if x == y:
                continue
            code = "missing_in_candidate" if y is None else "unexpected_in_candidate" if x is None else "type_mismatch" if x[0] != y[0] else "value_mismatch"
            if code != "value_mismatch":
                gone.append(path)
            count += 1
            if len(examples) < MOST_EXAMPLES:
                examples.append({"code": code, "month": a["month"], "path": path})
    return count, examples


def compare(packet: str, reference: str, candidate: str, seal_path: str, output: str, artifact: str | None = None) -> dict:
    """Compare a sealed candidate with the reference months. A verdict closes nothing by itself.

    With an ``artifact``, the reference must be the sequence that it has verified.
    """
    manifest = verify_packet(packet)
    if artifact:
        check_reference(reference, artifact)
    sealed = load_seal(seal_path)
    if sealed["candidate_sha256"] != digest(files.read_regular(candidate)):
        raise CleanRoomError("the seal is of another candidate")
    if sealed["manifest_sha256"] != digest(files.read_regular(Path(packet) / "manifest.json")):
        raise CleanRoomError("the seal is of another packet")
    start, end = manifest["months"]["start"], manifest["months"]["end"]
    count, examples = differences([project(r) for r in sequence(reference, start, end)], sequence(candidate, start, end))
    value = {
        "debt_closed": False, "difference_count": count, "examples": examples, "months": manifest["months"]["count"],
        "schema_version": COMPARISON, "verdict": "different" if count else "exact_match",
    }
    files.write_once(output, canonical_bytes(value))
    return value
