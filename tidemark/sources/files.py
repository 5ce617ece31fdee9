"""Driver-side files: written once, replaced atomically, read only if regular."""

from __future__ import annotations

import os
import stat
import tempfile
from pathlib import Path

from tidemark.functions.canonical import digest

MOST = 16 * 1024 * 1024


class EvidenceError(RuntimeError):
    """A file is not what it must be."""


def read_regular(path: str | Path, most: int = MOST) -> bytes:
    """The bytes of a regular file (no link) that doesn't change while it is read."""
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    except OSError as error:
        raise EvidenceError(f"{Path(path).name} can't be opened") from error
    with os.fdopen(handle, "rb") as file:
        before = os.fstat(file.fileno())
        if not stat.S_ISREG(before.st_mode) or before.st_size > most:
            raise EvidenceError(f"{Path(path).name} is no regular file of an allowed size")
        data = file.read(before.st_size + 1)
        after = os.fstat(file.fileno())
    if len(data) != before.st_size or (before.st_mtime_ns, before.st_ino) != (after.st_mtime_ns, after.st_ino):
        raise EvidenceError(f"{Path(path).name} changed while it was read")
    return data


def _beside(target: Path, data: bytes, mode: int) -> str:
    """A complete file in the target's folder."""
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.chmod(name, mode)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return name


def replace(path: str | Path, data: bytes, mode: int = 0o600) -> None:
    """Write next to the target, then move over it."""
    name = _beside(Path(path), data, mode)
    try:
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_once(path: str | Path, data: bytes, mode: int = 0o600) -> bool:
    """Create a file, or accept one with the same bytes; True if it was created. Of two writers one creates it."""
    name = _beside(Path(path), data, mode)
    try:
        os.link(name, path)  # fails if there is one
        return True
    except FileExistsError:
        if read_regular(path, max(MOST, len(data) + 1)) != data:
            raise EvidenceError(f"{Path(path).name} exists with other content") from None
        return False
    finally:
        Path(name).unlink(missing_ok=True)


def exists(path: str | Path) -> bool:
    return os.path.lexists(path)


def inside(path: str | Path, folder: str | Path) -> bool:
    """Whether a path is one of the files that go into a folder."""
    return Path(folder).resolve() in (Path(path).resolve(), *Path(path).resolve().parents) and Path(path).name in ("assembly.json", "report.json", "report.md")


def describe(path: str | Path, name: str, most: int = 1 << 40) -> dict:
    data = read_regular(path, most)
    return {"bytes": len(data), "path": name, "sha256": digest(data)}
