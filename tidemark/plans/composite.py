"""The composite at every assembly date in one plan: as-of histories, transforms, scores, families, tiers.

Nothing here loops over dates: all of them are keys of the same joins, windows and aggregates. Metadata (the registry) is
ten rows and broadcast; histories are partitioned by assembly date and family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions.values import month_of, six_places
from tidemark.operators import bands, compose, pit, transforms
from tidemark.registry import registry

POOLED = "pooled_yoy_growth"


def modes(spark: SparkSession) -> DataFrame:
    """(assembly_date, provisional) of all scheduled assemblies: those that finalise no month are provisional."""
    final = calendar.finalizations(spark).select(F.col("finalized_on").alias("final_date"))
    days = calendar.assemblies(spark).select("assembly_date").distinct()
    joined = days.join(F.broadcast(final), F.col("assembly_date") == F.col("final_date"), "left")
    return joined.select("assembly_date", F.col("final_date").isNull().alias("provisional"))


def histories(spans: DataFrame, dates: DataFrame, inclusive_start: bool = True, coverage: DataFrame | None = None) -> DataFrame:
    """What is knowable of the engine's series at each date, with the registry's columns.

    With ``coverage`` (series_id, complete_through) it fails closed: a date beyond what a series is covered for, or a
    series without coverage, has no history. Spans may have a ``mode``, canonical or provisional: they hold at
    assemblies of that mode only.
    """
    series = registry(spans.sparkSession, engine_only=True).withColumnRenamed("source", "known_source")
    rows = pit.as_of(spans, dates, inclusive_start=inclusive_start).join(F.broadcast(series), "series_id")
    if "mode" in spans.columns:
        rows = rows.join(F.broadcast(modes(spans.sparkSession)), "assembly_date", "left")
        own = F.when(F.coalesce("provisional", F.lit(True)), "provisional").otherwise("canonical")
        rows = rows.where(F.col("mode").isNull() | (F.col("mode") == own)).drop("mode")
    if coverage is not None:
        rows = pit.guard_coverage(rows, coverage).where("covered").drop("complete_through", "reason", "covered")
    return rows


def checked(rows: DataFrame) -> DataFrame:
    """Histories with each observation's number and, if it can't be used, a code.

    Where rows say where they come from (source, availability_basis), the rules of a snapshot are codes too.
    """
    rows = transforms.numeric_issues(rows, ["assembly_date", "series_id"])
    shifted = F.date_add("observation_date", F.col("shift_days"))
    off_grid = (
        F.when(F.col("frequency") == "weekly", F.weekday(shifted) != 2)
        .when(F.col("frequency") == "quarterly", (F.dayofmonth("observation_date") != 1) | ~F.month("observation_date").isin(1, 4, 7, 10))
        .otherwise(F.dayofmonth("observation_date") != 1)
    )
    code = F.coalesce("code", F.when(off_grid, "off_grid"))
    if {"source", "availability_basis"} <= set(rows.columns):
        rows = pit.snapshot_issues(rows.withColumn("asked_series", F.col("series_id"))).drop("asked_series")
        code = F.coalesce(F.when(F.size("codes") > 0, F.concat(F.lit("snapshot:"), F.get("codes", F.lit(0)))), code)
    return rows.withColumns({"code": code, "number": F.when(code.isNull(), F.col("number"))})


def member_state(
    rows: DataFrame, dates: DataFrame, date_col: str = "assembly_date", limits: dict[str, int] | None = None,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """A row for each date and expected member: whether it is missing, invalid or stale.

    Invalid: a date that the coverage doesn't reach; an observation that is no number (other than the missing mark), is
    off its grid, repeated, or breaks a rule of snapshots; or a newest observation without a number. Stale: the newest
    release over the whole history is older than the limit.
    """
    spark = rows.sparkSession
    series = registry(spark, engine_only=True).select("series_id", "family", "ord", "staleness_days")
    if limits:
        given = F.create_map(*[F.lit(x) for p in limits.items() for x in p])
        series = series.withColumn("staleness_days", F.coalesce(given[F.col("series_id")], "staleness_days"))
    expected = dates.select(date_col).distinct().crossJoin(F.broadcast(series))  # eight rows
    uncovered = F.lit(False)
    if coverage is not None:
        expected = pit.guard_coverage(expected, coverage, date_col)
        uncovered = ~F.col("covered")
    assumed = F.col("availability_basis") == pit.BASES[1] if "availability_basis" in rows.columns else F.lit(False)
    found = rows.groupBy(date_col, "series_id").agg(
        F.max("release_date").alias("newest_release"),
        F.count_if(F.col("code").isNotNull() & (F.col("code") != "missing_value")).alias("errors"),
        F.max_by("code", "observation_date").alias("newest_code"),
        F.max(assumed).alias("assumed"),
    )
    age = F.datediff(F.col(date_col), F.col("newest_release"))
    return expected.join(found, [date_col, "series_id"], "left").select(
        date_col, "family", "series_id", "ord", "newest_release",
        (F.col("errors").isNull() & ~uncovered).alias("is_missing"),
        (uncovered | F.coalesce(F.col("errors") > 0, F.lit(False)) | F.col("newest_code").isNotNull() | F.coalesce(age < 0, F.lit(False))).alias("is_invalid"),
        F.coalesce(age > F.col("staleness_days"), F.lit(False)).alias("is_stale"),
        F.coalesce("assumed", F.lit(False)).alias("assumed"),
    )


def grid(rows: DataFrame) -> DataFrame:
    """(assembly_date, family, series_id, ord, transform, frequency, month_idx, value) of numeric observations.

    Weekly series become means of complete months, after their shift to Wednesdays. The others have one observation a
    month, which is its own mean, so that all of them pass through one aggregate.
    """
    keys = ["assembly_date", "family", "series_id", "ord", "transform", "frequency"]
    day = F.date_add("observation_date", F.col("shift_days"))
    moved = rows.where("number is not null").withColumn("day", F.when(F.col("frequency") == "weekly", day).otherwise(F.col("observation_date")))
    monthly = moved.groupBy(*keys, month_of(F.col("day")).alias("month_idx")).agg(
        F.avg("number").alias("value"), F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day")
    )
    whole = (F.col("frequency") != "weekly") | (F.col("n") == transforms.wednesdays_in_month(F.col("last_day")))
    return monthly.where(whole).drop("n", "last_day")


def transformed(points: DataFrame) -> DataFrame:
    """(assembly_date, family, unit, ord, frequency, month_idx, value, error): pools by family, others by series.

    One window finds the values of a year before, one aggregate adds up the members of a unit: growth needs all of them
    with a prior value, levels have one member and need none.
    """
    pooled = F.col("transform") == POOLED
    growing = F.col("transform").isin(POOLED, "yoy_growth")
    members = registry(points.sparkSession, engine_only=True).where(pooled)
    members = members.groupBy("family").agg(F.count(F.lit(1)).alias("n_members"))
    rows = points.withColumn("prior", transforms.year_ago("value", ["assembly_date", "family", "series_id"]))
    rows = rows.join(F.broadcast(members), "family", "left").select(
        "assembly_date", "family", "month_idx", "value", "prior", "transform",
        F.when(pooled, F.col("family")).otherwise(F.col("series_id")).alias("unit"),
        F.when(pooled, 0).otherwise(F.col("ord")).alias("ord"),
        F.when(pooled, "monthly").otherwise(F.col("frequency")).alias("frequency"),
        F.when(pooled, F.col("n_members")).otherwise(1).alias("n_members"),
    )
    units = rows.groupBy("assembly_date", "family", "unit", "ord", "frequency", "transform", "n_members", "month_idx").agg(
        F.sum("value").alias("total"), F.sum("prior").alias("prior_total"), F.count("prior").alias("there")
    )
    units = units.where(~growing | (F.col("there") == F.col("n_members")))
    error = growing & (F.col("prior_total") == 0)
    growth = F.when(~error, -(F.col("total") - F.col("prior_total")) / F.col("prior_total"))
    return units.select(
        "assembly_date", "family", "unit", "ord", "frequency", "month_idx",
        F.when(growing, growth).otherwise(transforms.level(F.col("transform"), F.col("total"))).alias("value"),
        error.alias("error"),
    )


def scored(points: DataFrame, ddof: int = 0) -> DataFrame:
    """The score of each unit's latest point against the 120 months before it; an error anywhere voids the unit."""
    keys = ["assembly_date", "family", "unit"]
    unit = Window.partitionBy(*keys)
    rows = points.withColumns({"now": F.max("month_idx").over(unit), "void": F.max("error").over(unit)})
    refs = (F.col("month_idx") < F.col("now")) & (F.col("month_idx") >= F.col("now") - transforms.WINDOW_MONTHS)
    value = F.when(refs, F.col("value"))
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    out = rows.groupBy(*keys, "ord", "frequency").agg(
        F.max("now").alias("month_idx"),
        F.max("void").alias("void"),
        F.max(F.when(F.col("month_idx") == F.col("now"), F.col("value"))).alias("value"),
        F.count(value).alias("n_refs"),
        F.avg(value).alias("mean"),
        spread(value).alias("sigma"),
    )
    minimum = F.when(F.col("frequency") == "quarterly", transforms.MIN_QUARTERLY).otherwise(transforms.MIN_MONTHLY)
    reason = (
        F.when(F.col("void"), "invalid_transform")
        .when(F.col("n_refs") < minimum, F.format_string("z_abstention:insufficient_history:%d<%d", "n_refs", minimum))
        .when(F.col("value").isNull() | F.isnan("value"), "z_abstention:non_finite_value")
        .when(F.col("sigma") <= 0, "z_abstention:zero_population_sigma")
    )
    out = out.withColumn("reason", reason)
    z = (F.col("value") - F.col("mean")) / F.col("sigma")
    from tidemark.functions.values import clamp

    return out.withColumn("z", clamp(F.when(F.col("reason").isNull(), z), transforms.CAP)).drop("mean", "sigma", "void")


def families(
    spans: DataFrame, dates: DataFrame, inclusive_start: bool = True, ddof: int = 0, limits: dict[str, int] | None = None,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """Every family at every date: z (null if it abstains), flags, the latest transformed value and its month."""
    spark = spans.sparkSession
    rows = checked(histories(spans, dates, inclusive_start, coverage))
    state = member_state(rows, dates, limits=limits, coverage=coverage)
    released = F.when(F.col("newest_release").isNotNull(), F.struct("series_id", "newest_release"))
    gated = compose.gate(
        state, ["assembly_date", "family"],
        more={"releases": F.map_from_entries(F.sort_array(F.collect_list(released))), "assumed": F.max("assumed")},
    )
    units = registry(spark, engine_only=True)
    expected = units.select(
        "family", "ord", "tier", F.when(F.col("transform") == POOLED, F.col("family")).otherwise(F.col("series_id")).alias("unit")
    ).groupBy("family", "unit").agg(F.min("ord").alias("ord"), F.max("tier").alias("tier"))
    points = scored(transformed(grid(rows)), ddof).drop("ord")
    every = dates.select("assembly_date").distinct().crossJoin(F.broadcast(expected))  # six units
    joined = every.join(points, ["assembly_date", "family", "unit"], "left")
    reason = F.when(F.col("z").isNull(), F.coalesce("reason", F.lit("z_abstention:no_transformed_observations")))
    named = F.when(F.col("family") == "strain", F.regexp_replace(reason, "^(z_abstention|invalid_transform)", F.concat(F.lit("$1:"), "unit"))).otherwise(reason)
    by_family = joined.withColumn("flag", named).groupBy("assembly_date", "family").agg(
        F.avg("z").alias("mean_z"),
        F.count("z").alias("scored"),
        F.count(F.lit(1)).alias("units"),
        F.max("tier").alias("tier"),
        F.max("month_idx").alias("month_idx"),
        F.max_by("value", "ord").alias("value"),
        F.sort_array(F.collect_list(F.when(F.col("flag").isNotNull(), F.struct("ord", "flag")))).alias("reasons"),
    )
    out = gated.join(by_family, ["assembly_date", "family"])
    available = ~F.col("abstained") & (F.col("scored") == F.col("units"))
    return out.select(
        "assembly_date", "family", "tier",
        F.when(available, F.col("mean_z")).alias("z"),
        (~available).alias("abstained"),
        F.when(F.col("abstained"), F.col("flags")).otherwise(F.transform("reasons", lambda r: r["flag"])).alias("flags"),
        F.when(available & (F.col("units") == 1), F.col("value")).alias("transformed_value"),
        F.when(available, F.col("month_idx")).alias("month_idx"),
        "releases", "assumed",
    )


def assemblies(spans: DataFrame, dates: DataFrame, **rules) -> DataFrame:
    """Tier A, tier B and headline at every date, with abstentions as flags, and the mode that the calendar gives it.

    A date that is no scheduled assembly has a first flag that says so, and values nobody may publish: it is provisional.
    """
    return tiers_of(families(spans, dates, **rules))


def tiers_of(found: DataFrame) -> DataFrame:
    """The assemblies of families that have been computed already."""
    found = compose.tiers(found, ["assembly_date"])
    found = found.join(F.broadcast(modes(found.sparkSession)), "assembly_date", "left")
    odd = F.when(F.col("provisional").isNull(), F.array(F.lit("invalid_assembly_date"))).otherwise(F.array().cast("array<string>"))
    return found.withColumns({"flags": F.concat(odd, "flags"), "provisional": F.coalesce("provisional", F.lit(True))})


def frozen(assembled: DataFrame, months: DataFrame, include_current: bool = False, dwell: int = bands.DWELL, burn_in: int = bands.BURN_IN) -> DataFrame:
    """One record a month: the assembly that finalises it, its bands and dwell state, and tier B on tier A's thresholds.

    Provisional assemblies finalise nothing.
    """
    if "provisional" in assembled.columns:
        assembled = assembled.where("not provisional")
    rows = assembled.join(F.broadcast(months), F.col("assembly_date") == F.col("finalized_on"))
    rows = rows.withColumn("panel", F.lit(0))
    rows = bands.thresholds(rows, ["panel"], "tier_a", include_current, burn_in, burn_in - 1)
    rows = bands.dwell(bands.raw_band(rows), ["panel"], months=dwell)
    from tidemark.functions.values import classify

    mapped = classify(F.col("tier_b"), F.col("p70"), F.col("p85"), F.col("p95"))
    return rows.withColumn("tier_b_mapped_band", mapped).drop("panel")


def demo_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintage spans of all eight series from the order tables: what was shipped by then of each month's orders.

    Weekly series come from ship weeks by return flag, known nine days later; one of them is stamped on Mondays.
    """
    from tidemark.plans import fixtures as fx

    orders = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    day = fx.shifted("o_orderdate")
    series = F.expr(
        "case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'RSFSDP' when o_orderpriority = '1-URGENT' then 'RSFHFS' "
        "when o_orderpriority = '2-HIGH' then 'VISASMIDSA' when o_orderpriority = '3-MEDIUM' then 'UMICH_SCA_T2N_TOP' "
        "when o_orderpriority = '4-NOT SPECIFIED' then 'REVOLSL' else 'DRCCLACBS' end"
    )
    start = F.when(series == "DRCCLACBS", F.trunc(day, "quarter")).otherwise(F.trunc(day, "MM"))
    # A first print a month after the period, of the orders of its first half; the whole sum a month later.
    first = F.dayofmonth(day) <= 15
    dated = orders.select(series.alias("series_id"), start.alias("observation_date"), "o_totalprice", first.alias("early"))
    sums = dated.groupBy("series_id", "observation_date").agg(
        F.sum(F.when(F.col("early"), F.col("o_totalprice").cast("decimal(18,2)"))).alias("early"), fx.money("o_totalprice").alias("total")
    )
    length = F.when(F.col("series_id") == "DRCCLACBS", 3).otherwise(1)
    known = F.date_add(F.add_months("observation_date", length), 20)
    prints = sums.select(
        "series_id",
        "observation_date",
        F.explode(
            F.array(
                F.struct(known.alias("realtime_start"), F.date_add(known, 27).alias("realtime_end"), F.col("early").alias("v")),
                F.struct(F.date_add(known, 28).alias("realtime_start"), F.lit(pit.FOREVER).cast("date").alias("realtime_end"), F.col("total").alias("v")),
            )
        ).alias("p"),
    ).select("series_id", "observation_date", "p.realtime_start", "p.realtime_end", F.col("p.v").cast("string").alias("value_text"))
    prints = prints.where("value_text is not null")
    week = fx.weekly(spark, sf_dir)
    flag = F.when(F.col("series") == "A", "DPSACBW027SBOG").otherwise("WRMFNS")
    weekly = week.select(
        flag.alias("series_id"),
        F.date_sub("wed", F.when(F.col("series") == "A", 0).otherwise(2)).alias("observation_date"),
        F.date_add("wed", 9).alias("realtime_start"),
        F.lit(pit.FOREVER).cast("date").alias("realtime_end"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value_text"),
    )
    return prints.unionByName(weekly)


def with_provenance(spans: DataFrame) -> DataFrame:
    """Demo spans that say where they come from.

    The archived series' first prints, which end, are preliminary and hold in provisional weeks; its last ones are final,
    and taken to have been known when they were released.
    """
    archived = F.col("series_id") == "UMICH_SCA_T2N_TOP"
    last = F.col("realtime_end") == F.lit(pit.FOREVER).cast("date")
    return spans.withColumns(
        {
            "source": F.when(archived, "archive").otherwise("alfred"),
            "availability_basis": F.when(archived & last, pit.BASES[1]).otherwise(pit.BASES[0]),
            "release_stage": F.when(archived, F.when(last, "final").otherwise("preliminary")),
            "retrieved_at": F.when(archived, F.concat(F.col("realtime_start").cast("string"), F.lit("T12:00:00Z"))),
            "mode": F.when(archived & ~last, "provisional"),
        }
    )


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: six_places(F.col(c)) for c in columns})
