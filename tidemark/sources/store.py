"""The vintage store: four keyed tables, each a log of batches merged on reading, and read snapshots.

A state is a small numbered file that names the parts of all tables. A merge writes its batch and nothing else, then
claims the next number; a reader takes the last complete state, so it sees all tables at one moment, and a failed or
crashed job changes nothing: the states before it stay where they are. Of two writers that start from one state, one
claims the number, and the other is told. Compaction and vacuum keep the number of parts and of old states bounded.
"""

from __future__ import annotations

import json
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import pit
from tidemark.sources.mergelog import Entry, Layout, MergeLog

#: What is known of a span keeps its first fetch and its source; vintages are only added; coverage never goes back.
TABLES = {
    "observation_spans": Layout(
        schemas.SPANS, pit.KEY, dict.fromkeys(("first_fetched_at", "source", "source_file"), "first"), ("series_id", "observation_date"), 32
    ),
    "vintage_dates": Layout(schemas.VINTAGES, ("series_id", "vintage_date"), {"fetched_at": "first"}, buckets=8),
    "series_coverage": Layout(schemas.COVERAGE, ("series_id",), {"complete_through": "greatest"}, buckets=1),
    "fetch_runs": Layout(schemas.RUNS, ("id",), buckets=1),
}


class VintageCoverageError(LookupError):
    """A vintage is asked for that the store can't vouch for."""


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the store since this one has read it."""


def provider_health(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether all runs went well, and how often they were slowed down, over all of them or by key."""
    grouped = runs.groupBy(*(keys or []))
    fine = F.every(F.coalesce(F.col("status") == "ok", F.lit(False)))
    word = F.when(fine.isNull(), "unknown").when(fine, "ok").otherwise("degraded")
    return grouped.agg(word.alias("provider_health"), F.coalesce(F.sum("rate_limited"), F.lit(0)).cast("long").alias("rate_limited"))


class VintageStore:
    """A store under one root, on any file system that Spark reads and writes."""

    #: Batches of a table, before its buckets are compacted.
    MOST_DELTAS = 32
    #: Seconds after which a state that was claimed and never completed is taken for that of a crashed writer.
    PATIENCE = 5.0

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._path("states")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> dict[str, dict] | None:
        """A state; None while it isn't complete: its last character is a line feed."""
        fs, path = self._path(f"states/{number:08d}")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def state(self) -> tuple[int, dict[str, dict]]:
        """The highest number that is claimed, and the last complete state: table -> its entry."""
        numbers = self._numbers()
        for n in reversed(numbers):
            if (found := self._read(n)) is not None:
                return numbers[-1], found
        return (numbers[-1] if numbers else 0), {}

    def log(self, name: str) -> MergeLog:
        return MergeLog(self.spark, f"{self.root}/{name}", TABLES[name], lambda part: self._path(f"{name}/{part}"))

    def table(self, name: str, state: dict[str, dict] | None = None) -> DataFrame:
        """A table at the current (or a given) state, with its schema; empty before the first write."""
        entry = (self.state()[1] if state is None else state).get(name)
        return self.log(name).read(Entry.of(entry))

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables at one moment: later merges don't show in them."""
        state = self.state()[1]
        return {name: self.table(name, state) for name in TABLES}

    def _base(self) -> tuple[int, dict[str, dict]]:
        """The state to start a merge from; one that is being written is waited for."""
        claimed, state = self.state()
        until = time.monotonic() + self.PATIENCE
        while claimed and self._read(claimed) is None and time.monotonic() < until:
            time.sleep(0.2)
            claimed, state = self.state()
        return claimed, state

    def _claim(self, base: tuple[int, dict[str, dict]], name: str, entry: Entry) -> tuple[int, dict[str, dict]]:
        """Make ``entry`` the table's in the next state, which is returned."""
        claimed, state = base
        new = {**state, name: entry.plain()}
        fs, path = self._path(f"states/{claimed + 1:08d}")
        try:
            stream = fs.create(path, False)
        except Exception as error:
            if fs.exists(path):
                raise ConcurrentWrite(f"state {claimed + 1} is another writer's") from error
            raise
        stream.write(bytearray((json.dumps(new, sort_keys=True) + "\n").encode()))
        stream.close()
        return claimed + 1, new

    def _commit(self, base: tuple[int, dict[str, dict]], name: str, rows: DataFrame, order: list[str] | None = None) -> None:
        """Write the rows of a batch, and make them the table's in the next state; compact a table of many batches."""
        entry = self.log(name).append(Entry.of(base[1].get(name)), rows, base[0] + 1, order)
        after = self._claim(base, name, entry)
        if len(entry.deltas) > self.MOST_DELTAS:
            self._claim(after, name, self.log(name).compact(entry))

    def compact(self, name: str, least: int = 2) -> int:
        """Write the buckets of a table anew that have ``least`` parts or more; returns how many parts that saves."""
        base = self._base()
        old = Entry.of(base[1].get(name))
        new = self.log(name).compact(old, least)
        if new != old:
            self._claim(base, name, new)
        return sum(old.parts().values()) - sum(new.parts().values())

    def vacuum(self, keep: int = 16, older_than: float = 86_400.0) -> list[str]:
        """Remove all states but the last ``keep``, and the parts that no state left names. Returns what went.

        Parts younger than ``older_than`` seconds stay, as a writer may be about to name them. A reader that started from
        a state that goes may fail; it has to start again.
        """
        numbers = self._numbers()
        complete = [n for n in numbers if self._read(n) is not None]
        kept = set(complete[-max(1, keep) :]) | {n for n in numbers if n > (complete or [0])[-1]}
        named = [state for n in kept if (state := self._read(n)) is not None]
        gone = []
        for table in TABLES:
            fs, path = self._path(table)
            used = set().union(*[Entry.of(state.get(table)).folders() for state in named])
            for part in fs.listStatus(path) if fs.exists(path) else []:
                if part.getPath().getName() not in used and time.time() - part.getModificationTime() / 1000 >= older_than:
                    gone.append(f"{table}/{part.getPath().getName()}")
        for n in numbers:
            if n not in kept:
                gone.append(f"states/{n:08d}")
        for name in gone:
            fs, path = self._path(name)
            fs.delete(path, True)
        return gone

    def integrity_issues(self, state: dict[str, list[str]] | None = None) -> DataFrame:
        """(table, code, n): repeated or null keys, and spans that end before they start, of all tables of a state."""
        state = self.state()[1] if state is None else state
        found = []
        for name, layout in TABLES.items():
            rows, keys, odd = self.table(name, state), layout.keys, F.lit(False)
            for k in keys:
                odd |= F.col(k).isNull()
            found.append(rows.where(odd).select(F.lit(name).alias("table"), F.lit("null_key").alias("code")))
            twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            found.append(twice.select(F.lit(name).alias("table"), F.lit("repeated_key").alias("code")))
        spans = self.table("observation_spans", state).where("realtime_start > realtime_end")
        found.append(spans.select(F.lit("observation_spans").alias("table"), F.lit("reversed_span").alias("code")))
        every = found[0]
        for frame in found[1:]:
            every = every.unionByName(frame)
        return every.groupBy("table", "code").agg(F.count(F.lit(1)).alias("n"))

    def copy(self, target: str) -> VintageStore:
        """A checked copy of the state of one moment under another root, which must be empty."""
        state = self.state()[1]
        if (wrong := self.integrity_issues(state).collect()):
            raise ValueError(f"the store has issues: {[tuple(r) for r in wrong]}")
        other = VintageStore(self.spark, target)
        if other.state() != (0, {}):
            raise ValueError("the target is a store already")
        for name in TABLES:
            rows = self.table(name, state)
            other._commit(other._base(), name, rows)
            if rows.count() != other.table(name).count() or not rows.exceptAll(other.table(name)).isEmpty():
                raise ValueError(f"the copy of {name} differs")
        return other

    def upsert_spans(self, spans: DataFrame) -> int:
        """Merge spans by key; what is known keeps its first fetch and its source. Returns the rows given."""
        base = self._base()
        given = spans.count()
        self._commit(base, "observation_spans", spans, ["last_fetched_at"])
        return given

    def insert_vintages(self, vintages: DataFrame) -> int:
        base = self._base()
        given = vintages.count()
        self._commit(base, "vintage_dates", vintages, ["fetched_at"])
        return given

    def mark_backfilled(self, series_id: str, through: date) -> None:
        """Move a series' coverage on, never back; the time of the backfill always changes."""
        new = self.spark.createDataFrame([(series_id, through)], "series_id string, complete_through date")
        self.advance_coverage(new.withColumn("last_backfill_at", F.current_timestamp()))

    def advance_coverage(self, marks: DataFrame) -> None:
        """Move the coverage of many series on, each never back."""
        self._commit(self._base(), "series_coverage", marks, ["last_backfill_at"])

    def record_run(self, **run) -> None:
        """Append an audit row; ids count on."""
        base = self._base()
        last = self.table("fetch_runs", base[1]).agg(F.max("id")).first()[0] or 0
        names = TABLES["fetch_runs"].columns
        row = self.spark.createDataFrame([tuple({"id": last + 1, **run}.get(c) for c in names)], schemas.RUNS)
        self._commit(base, "fetch_runs", row)

    def complete_through(self, series_id: str) -> date | None:
        found = self.table("series_coverage").where(F.col("series_id") == series_id).select("complete_through").first()
        return found[0] if found else None

    def spans_at_vintage(self, series_id: str, vintage: date) -> DataFrame:
        """The spans of a series that hold at a vintage, in order of observation; fails closed without coverage."""
        through = self.complete_through(series_id)
        if through is None or vintage > through:
            raise VintageCoverageError(f"{series_id} isn't covered through {vintage}")
        held = (F.col("realtime_start") <= F.lit(vintage)) & (F.col("realtime_end") >= F.lit(vintage))
        return self.table("observation_spans").where((F.col("series_id") == series_id) & held).orderBy("observation_date")

    def first_fetched(self, series_id: str) -> DataFrame:
        """(observation_date, realtime_start, first_fetched_at) of a series: when each span became known here."""
        rows = self.table("observation_spans").where(F.col("series_id") == series_id)
        return rows.select("observation_date", "realtime_start", "first_fetched_at").orderBy("observation_date", "realtime_start")

    def provider_health(self) -> DataFrame:
        """One row over the newest runs: provider_health (ok, degraded, or unknown without runs) and rate_limited, in all."""
        return provider_health(self.latest_runs())

    def notes(self) -> DataFrame:
        """(series_id, code, detail): series without coverage, or whose newest run failed or was slowed down."""
        covered = self.table("series_coverage").where("complete_through is not null")
        runs = self.latest_runs()
        bare = runs.select("series_id").distinct().join(covered, "series_id", "left_anti")
        failed = runs.where("status <> 'ok'").select("series_id", F.lit("run_failed").alias("code"), F.col("error_summary").alias("detail"))
        slow = runs.where("rate_limited > 0").select("series_id", F.lit("rate_limited").alias("code"), F.col("rate_limited").cast("string").alias("detail"))
        bare = bare.select("series_id", F.lit("no_coverage").alias("code"), F.lit(None).cast("string").alias("detail"))
        return bare.unionByName(failed).unionByName(slow)

    def vintages_for(self, series_id: str) -> DataFrame:
        return self.table("vintage_dates").where(F.col("series_id") == series_id).select("vintage_date").orderBy("vintage_date")

    def latest_runs(self) -> DataFrame:
        """The newest run of each series and endpoint."""
        return pit.latest_version(self.table("fetch_runs"), ["series_id", "endpoint"], ["id"]).orderBy("series_id", "endpoint")

    def outcome_levels(self, series: list[str], vintage: date | None = None) -> tuple[DataFrame, DataFrame, date]:
        """Quarterly levels at the latest vintage that all these series have: (levels, issues, vintage)."""
        covered = self.table("series_coverage").where(F.col("series_id").isin(*series))
        found = covered.agg(F.min("complete_through"), F.count(F.lit(1))).first()
        if found[1] < len(set(series)):
            raise VintageCoverageError("a component has no coverage")
        at = vintage or found[0]
        if at > found[0]:
            raise VintageCoverageError(f"not covered through {at}")
        from tidemark.functions.values import number, quarter_of

        held = self.table("observation_spans").where(
            F.col("series_id").isin(*series) & (F.col("realtime_start") <= F.lit(at)) & (F.col("realtime_end") >= F.lit(at))
        )
        level = number(F.col("value_text"))
        twice = held.groupBy("series_id", "observation_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        code = F.when(F.col("value_text") == ".", "missing_level").when(level.isNull(), "invalid_level").when(level <= 0, "non_positive_level")
        rows = held.withColumns({"level": level, "code": code, "quarter_idx": quarter_of(F.col("observation_date"))})
        issues = rows.where("code is not null").select("series_id", "observation_date", "code").unionByName(
            twice.select("series_id", "observation_date", F.lit("overlapping_spans").alias("code"))
        )
        return rows.where("code is null").select("series_id", "quarter_idx", "level"), issues, at
