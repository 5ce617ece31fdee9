"""Canonical JSON: sorted keys, no spaces, floats at six places, one line feed at the end."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import ROUND_HALF_EVEN, Decimal

QUANTUM = Decimal("0.000001")


def six(value: float | Decimal) -> str:
    """Six places, half to even on the shortest decimal of a float; negative zero is zero."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("only finite numbers have a canonical form")
    exact = (value if isinstance(value, Decimal) else Decimal(str(value))).quantize(QUANTUM, ROUND_HALF_EVEN)
    return format(exact + 0 if exact else Decimal("0.000000"), "f")


def _text(value) -> str:
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (float, Decimal)):
        return six(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_text, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be texts")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(value[k])}" for k in sorted(value)) + "}"
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_bytes(value) -> bytes:
    return (_text(value) + "\n").encode()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key is repeated")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def parse_strict(text: str | bytes):
    """JSON without repeated keys, NaN or infinities."""
    return json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_no_constant)


def parse_canonical(data: bytes):
    """The value of canonical bytes; ValueError if they are not exactly what the value would be written as."""
    value = parse_strict(data)
    if canonical_bytes(value) != data:
        raise ValueError("not canonical")
    return value
