"""An independent second path: the same composite by joins, aggregates and arrays instead of window functions.

It shares only schemas, the registry and the calendar with the first path. Its rules can be changed to seed faults; a
changed set can never be called verified. ``verify_sequence`` checks frozen records against what it recomputes, and
against themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions import values as V
from tidemark.operators import compare
from tidemark.registry import FAMILIES, LEADING, registry
from tidemark.schemas import ARCHIVE_COLUMNS


@dataclass(frozen=True)
class Rules:
    ddof: int = 0
    inclusive_start: bool = True
    include_current: bool = False
    dwell: int = 2
    burn_in: int = 36
    staleness: dict[str, int] = field(default_factory=dict)

    @property
    def changed(self) -> bool:
        return self != Rules()


#: Window, caps and minima of scores, as this path has them.
MONTHS_BACK, MOST, LEAST = 120, 3.0, {"quarterly": 20, "monthly": 36}
#: A millionth: scores and tiers are both stored at six places, so half of it may come from each.
TOLERANCE = 1.0001e-6


class EvidenceUnavailable(RuntimeError):
    """Something that a check needs isn't there, or can't be read."""


class EvidenceConflict(RuntimeError):
    """Two pieces of evidence contradict each other; ``debts`` are what else is missing."""

    def __init__(self, message: str, debts: tuple[str, ...] = ()) -> None:
        super().__init__(message)
        self.debts = debts


def archive_spans(spark: SparkSession, paths: list[str], mode: str, assume_unrevised: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans, coverage) of release files, read on this path's own: by the CSV source, file by file, closed by arrays.

    ``mode`` canonical takes final releases, provisional preliminary ones too. Raises on the first thing that is wrong;
    contradictions come before what is missing.
    """
    every, bare = None, []
    for path in paths:  # a handful of files
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
        names = [c.strip().lstrip("\ufeff") for c in rows.columns]
        if missing := sorted(set(ARCHIVE_COLUMNS) - set(names)):
            raise EvidenceUnavailable(f"a release file has no {missing[0]}")
        rows = rows.toDF(*names).select(*ARCHIVE_COLUMNS)
        bare += [path] * rows.isEmpty()
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise EvidenceUnavailable("there is no release file")
    known = F.broadcast(registry(spark).where("source = 'archive'").select("series_id", F.lit(True).alias("known")))
    day = lambda c: F.when(F.length(c) == 10, F.to_date(F.col(c).try_cast("timestamp")))
    got = F.to_date(F.when(F.col("retrieved_at").endswith("Z"), F.col("retrieved_at")).try_cast("timestamp"))
    rows = every.join(known, "series_id", "left").withColumns({"obs": day("observation_date"), "rel": day("release_date"), "got": got})
    from_day = F.col("rel") if assume_unrevised else F.greatest("rel", "got")
    rows = rows.withColumn("begins", from_day)
    good = F.col("known") & F.col("obs").isNotNull() & (F.col("rel") >= F.col("obs")) & (F.col("got") >= F.col("rel")) & (F.trim("value_text") != "") & F.col("release_stage").isin("preliminary", "final")
    one = rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("bad")).first()
    twice = rows.groupBy("series_id", "obs", F.greatest("rel", "got").alias("at")).agg(F.count_distinct("value_text", "release_stage", "release_date").alias("n"))
    if not twice.where("n > 1").isEmpty():
        raise EvidenceConflict("release files contradict each other", tuple(f"no rows in {p}" for p in bare))
    if one["bad"] or bare:
        raise EvidenceUnavailable("a release file has rows that break the rules" if one["bad"] else "a release file has no rows")
    through = rows.groupBy("series_id").agg(F.max("got").alias("complete_through"))
    kept = rows.where(F.col("release_stage") == "final") if mode == "canonical" else rows
    entry = F.struct("begins", F.col("rel").alias("release_date"), "value_text")
    lists = kept.groupBy("series_id", F.col("obs").alias("observation_date")).agg(F.array_sort(F.collect_set(entry)).alias("v"))
    lists = lists.join(through, "series_id")
    ends = F.transform("v", lambda x, i: F.struct(x.alias("e"), F.coalesce(F.date_sub(F.get("v", i + 1)["begins"], 1), F.col("complete_through")).alias("until")))
    spans = lists.select("series_id", "observation_date", F.explode(ends).alias("s")).select(
        "series_id", "observation_date", F.col("s.e.begins").alias("realtime_start"), F.col("s.until").alias("realtime_end"), "s.e.value_text", "s.e.release_date"
    )
    return spans, through


def shapes(lines: DataFrame) -> DataFrame:
    """(month, check) of lines (line) that are no records: no JSON, a repeated key, wrong keys, or values of wrong types.

    A line without a month has its start instead.
    """
    from tidemark.sources.frozen import KEYS

    texts = ("finalized_on", "month", "schema_version", "source_assembly_json", "source_assembly_sha256")

    def wrong(line: str) -> tuple[str, list[str]]:
        try:
            value = json.loads(line, object_pairs_hook=_once)
        except ValueError as error:
            return line[:40], ["repeated_key" if "repeated" in str(error) else "no_json"]
        if not isinstance(value, dict):
            return line[:40], ["no_record"]
        month, said = str(value.get("month"))[:40], []
        for part, keys in KEYS.items():
            inner = value if not part else value.get(part)
            if not isinstance(inner, dict) or set(inner) != keys:
                said.append(f"keys.{part or 'record'}")
        said += [f"type.{k}" for k in texts if not isinstance(value.get(k), str)]
        for f, state in value["families"].items() if isinstance(value.get("families"), dict) else ():
            fine = isinstance(state, dict) and set(state) == {"abstained", "flags", "z_score"} and isinstance(state["abstained"], bool)
            if not fine or not (state["z_score"] is None or isinstance(state["z_score"], float)):
                said.append(f"type.families.{f}")
        for part in ("composite", "band"):
            inner = value.get(part)
            numbers = {k: v for k, v in inner.items() if k.endswith("_value")} if isinstance(inner, dict) else {}
            said += [f"type.{part}.{k}" for k, v in numbers.items() if not (v is None or isinstance(v, float))]
        return month, said

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [wrong(x) for x in batch["line"]]
            yield pd.DataFrame([(m, c) for m, said in found for c in said], columns=["month", "check"])

    return lines.select("line").mapInPandas(check, "month string, check string")


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is repeated")
    return found


def kinds(spark: SparkSession) -> DataFrame:
    """(assembly_date, kind): canonical for the first scheduled assembly of a month from its 15th day on, else provisional.

    This path's own rule: that day finalises the month two months earlier. A day that isn't scheduled has no row.
    """
    days = calendar.assemblies(spark).select("assembly_date").distinct()
    late = F.dayofmonth("assembly_date") >= 15
    firsts = days.where(late).groupBy(F.trunc("assembly_date", "MM").alias("of")).agg(F.min("assembly_date").alias("first"))
    named = days.withColumn("of", F.trunc("assembly_date", "MM")).join(F.broadcast(firsts), "of", "left")  # a row for each month of the calendar
    final = F.coalesce(F.col("assembly_date") == F.col("first"), F.lit(False))
    return named.select("assembly_date", F.when(final, "canonical").otherwise("provisional").alias("kind"))


def held(spans: DataFrame, dates: DataFrame, rules: Rules) -> DataFrame:
    """As-of selection as the newest version that had started and not ended, by a grouped maximum.

    Spans and dates meet by year: a span is copied to each year it covers, up to the last one asked. Spans with a ``mode`` hold
    at assemblies of that kind alone.
    """
    asked = dates.select("assembly_date").distinct().withColumn("year", F.year("assembly_date"))
    last = asked.agg(F.max("year").alias("last_year"), F.min("year").alias("first_year"))
    years = F.sequence(F.greatest(F.year("realtime_start"), "first_year"), F.least(F.year("realtime_end"), "last_year"))
    inside = (F.year("realtime_start") <= F.col("last_year")) & (F.year("realtime_end") >= F.col("first_year"))
    copied = spans.crossJoin(F.broadcast(last)).where(inside & (F.col("realtime_start") <= F.col("realtime_end")))  # one row
    pairs = copied.withColumn("year", F.explode(years)).join(asked, "year")
    started = F.col("realtime_start") <= F.col("assembly_date") if rules.inclusive_start else F.col("realtime_start") < F.col("assembly_date")
    pairs = pairs.where(started & (F.col("assembly_date") <= F.col("realtime_end")))
    if "mode" in spans.columns:
        pairs = pairs.join(F.broadcast(kinds(spans.sparkSession)), "assembly_date", "left")
        pairs = pairs.where(F.col("mode").isNull() | (F.col("mode") == F.coalesce("kind", F.lit("provisional"))))
    release = F.coalesce("release_date", "realtime_start") if "release_date" in spans.columns else F.col("realtime_start")
    best = pairs.groupBy("assembly_date", "series_id", "observation_date").agg(
        F.max_by(F.struct("value_text", release.alias("release_date")), "realtime_start").alias("b"), F.count(F.lit(1)).alias("n")
    )
    return best.select("assembly_date", "series_id", "observation_date", "b.value_text", "b.release_date", "n")


def members(rows: DataFrame, dates: DataFrame, rules: Rules, coverage: DataFrame | None) -> DataFrame:
    """(assembly_date, family, flags, releases): what keeps each expected member from being used."""
    series = registry(rows.sparkSession, engine_only=True)
    limit = F.col("staleness_days")
    if rules.staleness:
        limit = F.coalesce(F.create_map(*[F.lit(x) for p in rules.staleness.items() for x in p])[F.col("series_id")], limit)
    day = F.date_add("observation_date", F.col("shift_days"))
    grid = (
        F.when(F.col("frequency") == "weekly", F.dayofweek(day) == 4)
        .when(F.col("frequency") == "quarterly", F.col("observation_date") == F.trunc("observation_date", "quarter"))
        .otherwise(F.col("observation_date") == F.trunc("observation_date", "MM"))
    )
    good = (F.col("n") == 1) & grid & F.coalesce(finite(F.col("value_text")).isNotNull() | (F.col("value_text") == "."), F.lit(False))
    told = rows.groupBy("assembly_date", "series_id").agg(
        F.count_if(~good).alias("bad"), F.max("release_date").alias("newest"), F.max_by("value_text", "observation_date").alias("text")
    )
    expected = dates.select("assembly_date").distinct().crossJoin(F.broadcast(series))  # eight rows
    reach = F.lit(True)
    if coverage is not None:
        expected = expected.join(coverage.select("series_id", "complete_through"), "series_id", "left")
        reach = F.coalesce(F.col("assembly_date") <= F.col("complete_through"), F.lit(False))
    state = expected.join(told, ["assembly_date", "series_id"], "left")
    word = (
        F.when(~reach, "invalid_member:").when(F.col("bad").isNull(), "missing_member:")
        .when((F.col("bad") > 0) | (F.col("text") == ".") | (F.col("newest") > F.col("assembly_date")), "invalid_member:")
        .when(F.date_add("newest", limit) < F.col("assembly_date"), "stale_member:")
    )
    flag = F.when(word.isNotNull(), F.struct("ord", F.concat(word, "series_id").alias("flag")))
    release = F.when(reach & F.col("newest").isNotNull(), F.struct("series_id", "newest"))
    return state.groupBy("assembly_date", "family").agg(
        F.array_sort(F.collect_list(flag)).alias("found"), F.map_from_entries(F.array_sort(F.collect_list(release))).alias("releases")
    ).select("assembly_date", "family", F.transform("found", lambda x: x["flag"]).alias("flags"), "releases")


def finite(text: Column) -> Column:
    """A number in plain or scientific notation, or null."""
    value = F.when(text.rlike("^[-+0-9.eE]+$"), text.try_cast("double"))
    return F.when(value.between(-1.7976931348623157e308, 1.7976931348623157e308), value)


def months(rows: DataFrame) -> DataFrame:
    """Arrays of (month, value) by assembly and series; weekly series only for months with all their Wednesdays."""
    rows = rows.where("n = 1").withColumn("value", finite(F.col("value_text"))).where("value is not null")
    rows = rows.withColumn("day", F.date_add("observation_date", F.col("shift_days")))
    rows = rows.withColumn("month_idx", F.year("day") * 12 + F.month("day") - 1)
    weekly = rows.where("frequency = 'weekly'").groupBy("assembly_date", "family", "series_id", "transform", "frequency", "month_idx").agg(
        F.collect_set("day").alias("days"), F.avg("value").alias("value")
    )
    some = F.element_at("days", 1)
    wanted = F.filter(F.sequence(F.trunc(some, "MM"), F.last_day(some)), lambda d: F.weekday(d) == 2)
    weekly = weekly.where(F.array_sort("days") == F.array_sort(wanted)).drop("days")
    other = rows.where("frequency <> 'weekly'").select(*weekly.columns)
    return other.unionByName(weekly)


def units(points: DataFrame) -> DataFrame:
    """Transformed points of each unit by self-joins on the month a year before."""
    growth = points.where(F.col("transform").isin("pooled_yoy_growth", "yoy_growth"))
    before = growth.select("assembly_date", "series_id", (F.col("month_idx") + 12).alias("month_idx"), F.col("value").alias("prior"))
    pairs = growth.join(before, ["assembly_date", "series_id", "month_idx"])
    members = {"census_retail": 2, "household_liquidity": 2}
    n = F.coalesce(F.create_map(*[F.lit(x) for p in members.items() for x in p])[F.col("family")], F.lit(1))
    unit = F.when(F.col("transform") == "pooled_yoy_growth", F.col("family")).otherwise(F.col("series_id"))
    summed = pairs.withColumn("unit", unit).groupBy("assembly_date", "family", "unit", "frequency", "month_idx").agg(
        F.sum("value").alias("v"), F.sum("prior").alias("p"), F.count(F.lit(1)).alias("n")
    )
    # The pools have weekly and monthly members with one grid, so their frequency plays no part any more.
    fallen = F.try_divide(F.col("p") - F.col("v"), F.col("p"))  # null where the year before sums to zero
    summed = summed.where(F.col("n") == n).select(
        "assembly_date", "family", "unit", F.lit("monthly").alias("frequency"), "month_idx", fallen.alias("value")
    )
    sign = F.when(F.col("transform") == "hundred_minus_level", 100.0 - F.col("value")).when(
        F.col("transform") == "inverted_level", -F.col("value")
    ).otherwise(F.col("value"))
    levels = points.where(~F.col("transform").isin("pooled_yoy_growth", "yoy_growth")).select(
        "assembly_date", "family", F.col("series_id").alias("unit"), "frequency", "month_idx", sign.alias("value")
    )
    return summed.unionByName(levels)


def scores(points: DataFrame, rules: Rules) -> DataFrame:
    """The latest point's score from an array of all points, or the reason why it has none: no windows."""
    packed = points.groupBy("assembly_date", "family", "unit", "frequency").agg(
        F.array_sort(F.collect_list(F.struct("month_idx", "value"))).alias("points")
    )
    now = F.element_at("points", -1)
    refs = F.transform(
        F.filter("points", lambda p: (p["month_idx"] < now["month_idx"]) & (p["month_idx"] >= now["month_idx"] - MONTHS_BACK)), lambda p: p["value"]
    )
    void = F.exists("points", lambda p: p["value"].isNull())
    packed = packed.withColumns({"refs": refs, "value": now["value"], "void": void}).withColumn("n", F.size("refs"))
    mean = F.aggregate("refs", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    packed = packed.withColumn("mean", F.when(F.col("n") > 0, mean))
    squares = F.aggregate(F.transform("refs", lambda x: F.pow(x - F.col("mean"), 2)), F.lit(0.0), lambda s, x: s + x)
    over = F.col("n") - rules.ddof
    least = F.when(F.col("frequency") == "quarterly", LEAST["quarterly"]).otherwise(LEAST["monthly"])
    flat = F.size(F.array_distinct("refs")) == 1
    packed = packed.withColumns({"sigma": F.when(over > 0, F.sqrt(squares / over)), "least": least})
    why = (
        F.when(F.col("void"), "invalid_transform")
        .when(F.col("n") < F.col("least"), F.concat(F.lit("z_abstention:insufficient_history:"), "n", F.lit("<"), "least"))
        .when(flat | ~(F.col("sigma") > 0), "z_abstention:zero_population_sigma")
    )
    z = F.when(why.isNull(), (F.col("value") - F.col("mean")) / F.col("sigma"))
    capped = F.when(z > MOST, MOST).when(z < -MOST, -MOST).otherwise(z)
    return packed.select("assembly_date", "family", "unit", capped.alias("z"), why.alias("why"))


def recompute(spans: DataFrame, dates: DataFrame, rules: Rules = Rules(), coverage: DataFrame | None = None) -> DataFrame:
    """(assembly_date, family, z, abstained, flags, releases) of all five families."""
    table = F.broadcast(registry(spans.sparkSession, engine_only=True).drop("source"))
    rows = held(spans, dates, rules)
    rows = rows.join(table, "series_id")
    if coverage is not None:
        known = coverage.select("series_id", "complete_through")
        rows = rows.join(known, "series_id").where(F.col("assembly_date") <= F.col("complete_through")).drop("complete_through")
    state = members(rows, dates, rules, coverage)
    found = scores(units(months(rows)), rules)
    # The units of a family, strain's in the order of its members.
    expected = [(f, f) for f in FAMILIES[:4:2]] + [("visa_smi", "VISASMIDSA"), ("umich_top_tercile", "UMICH_SCA_T2N_TOP"), ("strain", "REVOLSL"), ("strain", "DRCCLACBS")]
    wanted = spans.sparkSession.createDataFrame([(n, f, u) for n, (f, u) in enumerate(expected)], "nth int, family string, unit string")
    every = dates.select("assembly_date").distinct().crossJoin(F.broadcast(wanted))  # six rows
    joined = every.join(found, ["assembly_date", "family", "unit"], "left")
    why = F.when(F.col("z").isNull(), F.coalesce("why", F.lit("z_abstention:no_transformed_observations")))
    colon = F.locate(":", why)
    head = F.when(colon > 0, F.substr(why, F.lit(1), colon - 1)).otherwise(why)
    rest = F.when(colon > 0, F.substr(why, colon)).otherwise("")
    named = F.when(F.col("family") == "strain", F.concat(head, F.lit(":"), "unit", rest)).otherwise(why)
    both = joined.withColumn("flag", named).groupBy("assembly_date", "family").agg(
        F.avg("z").alias("z"), F.array_sort(F.collect_list(F.when(F.col("flag").isNotNull(), F.struct("nth", "flag")))).alias("reasons")
    ).join(state, ["assembly_date", "family"])
    silent = (F.size("flags") > 0) | (F.size("reasons") > 0)
    flags = F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.transform("reasons", lambda r: r["flag"]))
    return both.select("assembly_date", "family", F.when(~silent, F.col("z")).alias("z"), silent.alias("abstained"), flags.alias("flags"), "releases")


def composite(families: DataFrame, exact: bool = False) -> DataFrame:
    """Tiers, headline and flags of each assembly, with a column for each family instead of grouped lists.

    Values have six places, unless they are wanted ``exact``.
    """
    places = lambda x: x if exact else F.bround(x, 6) + 0.0
    wide = families.groupBy("assembly_date").pivot("family", list(LEADING)).agg(F.first("z"))
    gone = F.concat_ws(",", *[F.when(F.col(f).isNull(), F.lit(f)) for f in LEADING])
    n_gone = sum((F.col(f).isNull().cast("int") for f in LEADING), F.lit(0))
    there = len(LEADING) - n_gone

    def mean(names: tuple[str, ...]) -> Column:
        n = sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0))
        return F.when(n > 0, sum((F.coalesce(F.col(f), F.lit(0.0)) for f in names), F.lit(0.0)) / n)

    silent = there <= len(LEADING) - 2
    a = F.when(~silent, places(mean(tuple(f for f in LEADING if f != "visa_smi"))))
    b = F.when(~silent & F.col("visa_smi").isNotNull(), places(mean(LEADING)))
    last = F.when(silent, F.concat(F.lit("leading_abstained:"), n_gone, F.lit("_of_4_families"))).when(
        n_gone > 0, F.concat(F.lit("leading_renormalized:"), gone)
    )
    flags = F.concat_ws("|", *[F.when(F.col(f).isNull(), F.lit(f"family_abstention:{f}")) for f in LEADING], last)
    return wide.select(
        "assembly_date", a.alias("tier_a"), b.alias("tier_b"), F.coalesce(b, a).alias("headline"),
        F.when(b.isNotNull(), "B").when(a.isNotNull(), "A").alias("headline_tier"), silent.alias("abstained"), flags.alias("flags"),
    )


def label(wrong: DataFrame, n_records: int, n_debts: int) -> str:
    """The label that differences, records and open debts earn."""
    counted = wrong.agg(F.count(F.lit(1)).alias("n"))
    return counted.select(V.verification_label(F.col("n"), F.lit(n_records), F.lit(n_debts))).first()[0]


def verify(
    published: DataFrame, spans: DataFrame, dates: DataFrame, rules: Rules = Rules(), tolerance: float = TOLERANCE,
    coverage: DataFrame | None = None, debts: tuple[str, ...] = (),
) -> tuple[DataFrame, str]:
    """Differences between published families (assembly_date, family, z, abstained, flags) and recomputed ones, and the
    label they earn: all of z, abstention, flags and releases count."""
    mine = recompute(spans, dates, rules, coverage)
    mine = mine.select("assembly_date", "family", *[F.col(c).alias(f"own_{c}") for c in ("z", "abstained", "flags", "releases")])
    both = published.join(mine, ["assembly_date", "family"], "full_outer")
    odd = compare.differs(F.col("z"), F.col("own_z"), tolerance)
    for name in ("abstained", "flags"):
        if name in published.columns:
            odd |= ~F.col(name).eqNullSafe(F.col(f"own_{name}"))
    if "releases" in published.columns:
        entries = lambda c: F.array_sort(F.map_entries(c))
        odd |= ~entries("releases").eqNullSafe(entries("own_releases"))
    wrong = both.where(F.coalesce(odd, F.lit(True))).select("assembly_date", "family", "z", F.col("own_z").alias("recomputed"))
    return wrong, label(wrong, published.count(), len(debts) + rules.changed)


# --- frozen records --------------------------------------------------------------------------------------------------

_COMPOSITE = ("abstained", "headline_tier", "headline_value", "tier_a_value", "tier_b_value")
_BAND = ("candidate_band", "candidate_count", "confirmed_band", "eligible", "published_band", "raw_band", "reference_count")
_REPLAYED = "month string, " + ", ".join(
    f"{c} {k}" for c, k in zip(_BAND, ("string", "int", "string", "boolean", "string", "string", "int"))
) + ", p70 double, p85 double, p95 double, mapped string, chronology string"
#: What the assembly inside a record looks like.
SOURCE = (
    "struct<assembly_date:string,composite:struct<abstained:boolean,headline_tier:string,headline_value:double,tier_a_value:double,"
    "tier_b_value:double>,families:map<string,struct<abstained:boolean,flags:array<string>,member_release_dates:map<string,string>,"
    "transformed_value:double,transformed_value_redacted:boolean,z_score:double>>,flags:array<string>>"
)


def _differ(tolerance: float, **pairs: tuple[Column, Column]) -> Column:
    """The names of those pairs that aren't equal, numbers within the tolerance."""
    tests = []
    for name, (a, b, *number) in pairs.items():
        odd = compare.differs(a, b, tolerance) if number else compare.differs(a, b)
        tests.append(F.when(F.coalesce(odd, F.lit(True)), F.lit(name.replace("__", "."))))
    return F.array_compact(F.array(*tests))


def _replayed(records: DataFrame, rules: Rules) -> DataFrame:
    """The bands of a sequence, replayed month by month by the plain state machine: one record a month, a few hundred."""

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month", kind="stable")
        none = lambda x: None if x is None or x != x else x
        out, previous = [], None
        found = replay_bands([none(v) for v in frame["tier_a"]], rules)
        for (month, finalized, tier_b), now in zip(zip(frame["month"], frame["finalized_on"], frame["tier_b"]), found):
            cuts, b, said = now["thresholds"], none(tier_b), []
            mapped = None if cuts is None or b is None else band_of(b, *cuts)
            try:
                if calendar.monthly_finalization_date(month).isoformat() != finalized:
                    said.append("finalized_on")
                if previous and calendar.month_index(month) != calendar.month_index(previous) + 1:
                    said.append("month_gap")
            except ValueError:
                said.append("month")
            previous = month
            out.append((month, *(now[c] for c in _BAND), *(cuts or (None, None, None)), mapped, ",".join(said)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _REPLAYED.split(", ")])

    rows = records.select(
        F.lit(0).alias("panel"), "month", "finalized_on", F.col("composite.tier_a_value").alias("tier_a"), F.col("composite.tier_b_value").alias("tier_b")
    )
    return rows.where("month is not null").groupBy("panel").applyInPandas(replay, _REPLAYED)


def verify_sequence(
    records: DataFrame, spans: DataFrame | None, rules: Rules = Rules(), tolerance: float = TOLERANCE, coverage: DataFrame | None = None,
    debts: tuple[str, ...] = (), notices: dict[str, str] | None = None,
) -> tuple[DataFrame, str]:
    """(month, check) of everything about frozen records that isn't as it must be, and the label they earn.

    ``records`` are those of ``frozen.read``. Within a record: the hash of the assembly inside, its equality with what is
    outside, redaction, the arithmetic of tiers and headline, vintages and notices. Over the sequence: chronology, and
    the bands, replayed. Against the sources (if ``spans`` are given): families, flags, releases and composite,
    recomputed by the second path.
    """
    from tidemark.sources.frozen import NOTICES

    spark = records.sparkSession
    rows = records.withColumn("source", F.from_json("source_assembly_json", SOURCE))
    internal = registry(spark, engine_only=True).where("license = 'umich_internal'").select("family").distinct()
    hidden = F.array(*[F.lit(r["family"]) for r in internal.collect()])
    licences = {r["series_id"]: r["license"] for r in registry(spark).collect()}
    said = F.create_map(*[F.lit(x) for s, k in licences.items() for x in (s, (notices or NOTICES).get(k, ""))])
    expected = F.array_sort(F.array_distinct(F.filter(F.transform(F.map_keys("input_vintages"), lambda s: F.coalesce(said[s], F.lit("unknown series"))), lambda x: x != "")))
    inner = F.aggregate(
        F.map_values(F.col("source.families")), F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, f: F.concat(acc, F.map_entries(f["member_release_dates"])),
    )
    entries = lambda c: F.array_sort(F.map_entries(c))
    shown = F.filter(F.map_entries(F.col("source.families")), lambda e: (e["value"]["transformed_value_redacted"] != F.array_contains(hidden, e["key"])) | (e["value"]["transformed_value_redacted"] & e["value"]["transformed_value"].isNotNull()))
    states = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"], e["value"]["abstained"], e["value"]["flags"], e["value"]["z_score"])))
    own = composite(rows.select(F.col("month").alias("assembly_date"), F.explode("families").alias("family", "s")).select("assembly_date", "family", F.col("s.z_score").alias("z")), exact=True)
    own = own.select(F.col("assembly_date").alias("of_month"), *[F.col(c).alias(f"own_{c}") for c in own.columns[1:]])
    within = rows.join(own, F.col("month") == F.col("of_month"), "left").select(
        "month",
        F.concat(
            _differ(
                tolerance,
                source_hash=(F.sha2("source_assembly_json", 256), F.col("source_assembly_sha256")),
                **{f"source__composite__{c}": (F.col(f"source.composite.{c}"), F.col(f"composite.{c}")) for c in _COMPOSITE},
                source__families=(states(F.col("source.families")), states(F.col("families"))),
                source__flags=(F.col("source.flags"), F.col("assembly_flags")),
                source__date=(F.col("source.assembly_date"), F.col("finalized_on")),
                source__input_vintages=(F.array_sort(inner), entries("input_vintages")),
                license_notices=(expected, F.array_sort("license_notices")),
                redaction=(F.size(shown), F.lit(0)),
                family_set=(F.array_sort(F.map_keys("families")), F.lit(sorted(FAMILIES))),
                abstention=(F.size(F.filter(F.map_values("families"), lambda f: f["abstained"] != f["z_score"].isNull())), F.lit(0)),
                vintages=(F.size(F.filter(F.map_values("input_vintages"), lambda d: V.strict_date(d).isNull() | (d > F.col("finalized_on")))), F.lit(0)),
                arithmetic__tier_a=(F.col("own_tier_a"), F.col("composite.tier_a_value"), True),
                arithmetic__tier_b=(F.col("own_tier_b"), F.col("composite.tier_b_value"), True),
                arithmetic__headline=(F.col("own_headline"), F.col("composite.headline_value"), True),
                arithmetic__headline_tier=(F.col("own_headline_tier"), F.col("composite.headline_tier")),
                arithmetic__abstained=(F.col("own_abstained"), F.col("composite.abstained")),
            ),
        ).alias("checks"),
    )
    told = _replayed(records, rules)
    told = told.select(F.col("month").alias("of_month"), *[F.col(c).alias(f"own_{c}") for c in told.columns[1:]])
    banded = records.join(told, F.col("month") == F.col("of_month"), "left").select(
        "month",
        F.concat(
            F.filter(F.split("own_chronology", ","), lambda x: x != ""),
            _differ(
                tolerance,
                **{f"band__{c}": (F.col(f"own_{c}"), F.col(f"band.{c}")) for c in _BAND},
                **{f"band__{c}": (F.col(f"own_{c}"), F.col(f"band.thresholds.{c}"), True) for c in ("p70", "p85", "p95")},
                tier_b_mapped_band=(F.col("own_mapped"), F.col("composite.tier_b_mapped_band")),
            ),
        ).alias("checks"),
    )
    found = within.unionByName(banded)
    if spans is not None:
        dates = records.select(F.col("finalized_on").try_cast("date").alias("assembly_date")).where("assembly_date is not null").distinct()
        mine = recompute(spans, dates, rules, coverage)
        whole = composite(mine).select("assembly_date", F.col("flags").alias("own_flags"))
        mine = mine.select(F.col("assembly_date").cast("string").alias("day"), F.col("family").alias("name"), *[F.col(c).alias(f"own_{c}") for c in ("z", "abstained", "flags", "releases")])
        outer = records.select("month", "finalized_on", F.explode("families").alias("family", "s"))
        outer = outer.join(mine, (F.col("finalized_on") == F.col("day")) & (F.col("family") == F.col("name")), "left")
        same = _differ(
            tolerance, z_score=(F.col("own_z"), F.col("s.z_score"), True), abstained=(F.col("own_abstained"), F.col("s.abstained")),
            flags=(F.col("own_flags"), F.col("s.flags")),
        )
        found = found.unionByName(outer.select("month", F.transform(same, lambda c: F.concat(F.lit("sources."), "family", F.lit("."), c)).alias("checks")))
        dated = mine.select("day", F.explode("own_releases").alias("series_id", "d")).groupBy("day").agg(
            F.array_sort(F.collect_list(F.struct(F.col("series_id").alias("key"), F.col("d").cast("string").alias("value")))).alias("own")
        )
        outer = records.join(dated, F.col("finalized_on") == F.col("day"), "left").join(whole.withColumn("on", F.col("assembly_date").cast("string")), F.col("finalized_on") == F.col("on"), "left")
        plain = F.array_join(F.filter("assembly_flags", lambda x: ~x.startswith("validation_assumption:")), "|")
        same = _differ(
            tolerance, sources__input_vintages=(F.coalesce("own", F.array().cast("array<struct<key:string,value:string>>")), entries("input_vintages")),
            sources__assembly_flags=(F.col("own_flags"), plain),
        )
        found = found.unionByName(outer.select("month", same.alias("checks")))
    wrong = found.select("month", F.explode("checks").alias("check"))
    if "line" in records.columns:
        wrong = wrong.unionByName(shapes(records))
    wrong = wrong.distinct()
    return wrong, label(wrong, records.count(), len(debts) + rules.changed)


def band_of(value: float, low: float, mid: float, high: float) -> str:
    return V.BANDS[0] if value < low else V.BANDS[1] if value < mid else V.BANDS[2] if value <= high else V.BANDS[3]


def replay_bands(values: list[float | None], rules: Rules = Rules()) -> list[dict]:
    """The band state machine, month by month: the plain-Python twin of the window version."""
    from decimal import ROUND_HALF_EVEN, Decimal

    def cut(ordered: list[Decimal], q: int) -> Decimal:
        at, rest = divmod((len(ordered) - 1) * q, 100)
        low = ordered[at]
        high = ordered[min(at + 1, len(ordered) - 1)]
        return (low + (high - low) * rest / 100).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)

    out: list[dict] = []
    confirmed = candidate = None
    count = 0
    exact = [None if v is None else Decimal(str(v)).quantize(Decimal("0.000001"), ROUND_HALF_EVEN) for v in values]
    for n, now in enumerate(exact):
        refs = sorted(v for v in exact[: n + rules.include_current] if v is not None)
        eligible = n + 1 >= rules.burn_in and len(refs) >= rules.burn_in - 1
        cuts = tuple(cut(refs, q) for q in (70, 85, 95)) if eligible and refs else None
        raw = band_of(now, *cuts) if cuts and now is not None else None
        if raw is None or raw == confirmed:
            candidate, count = None, 0
        else:
            count = count + 1 if candidate == raw else 1
            candidate = raw
            if count >= rules.dwell:
                confirmed, candidate, count = raw, None, 0
        out.append(
            {
                "raw_band": raw, "confirmed_band": confirmed, "candidate_band": candidate, "candidate_count": count,
                "published_band": confirmed if raw else None, "eligible": eligible, "reference_count": len(refs),
                "thresholds": tuple(map(float, cuts)) if cuts else None,
            }
        )
    return out
