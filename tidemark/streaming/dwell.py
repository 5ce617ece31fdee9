"""The dwell state machine as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "panel string, month_idx int, raw_band string, confirmed_band string, candidate_band string, candidate_count int, published_band string"
STATE = "last int, confirmed string, candidate string, count int"


def advance(state: tuple, month: int, raw: str | None, dwell: int) -> tuple[tuple, tuple]:
    """The state after one month, and (confirmed, candidate, count, published) of that month."""
    _, confirmed, candidate, count = state
    if raw is None or raw == confirmed:
        candidate, count = None, 0
    else:
        count = count + 1 if candidate == raw else 1
        candidate = raw
        if count >= dwell:
            confirmed, candidate, count = raw, None, 0
    return (month, confirmed, candidate, count), (confirmed, candidate, count, confirmed if raw else None)


def dwell_stream(months: DataFrame, dwell: int = 2) -> DataFrame:
    """Published bands of a stream of (panel, month_idx, raw_band).

    The months of a batch are taken in order. A month that isn't later than the last one is refused: what is frozen stays
    as it is, and a batch that is delivered again changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (-1, None, None, 0)
        rows = pd.concat(list(frames)).sort_values("month_idx", kind="stable")
        out = []
        for month, raw in zip(rows["month_idx"].tolist(), rows["raw_band"].tolist()):
            if month <= now[0]:
                continue
            raw = raw if isinstance(raw, str) else None
            now, seen = advance(now, month, raw, dwell)
            out.append((key[0], month, raw, *seen))
        state.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return months.groupBy("panel").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
