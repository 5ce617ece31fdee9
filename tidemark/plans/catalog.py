"""The registered queries of the point-in-time operators, each with the SQL that has the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions import values as V
from tidemark.operators import pit, transforms
from tidemark.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL, or a function that writes it, if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month in which something was released, as assembly dates."""
    items = fx.read(spark, sf_dir, "lineitem")
    return items.select(F.trunc(fx.shifted("l_shipdate"), "MM").alias("assembly_date")).distinct()


_DATES = "dates AS (SELECT DISTINCT date_trunc('month', l_shipdate + INTERVAL 240 MONTH)::DATE AS assembly_date FROM lineitem)"


# --- as-of selection -------------------------------------------------------------------------------------------------


@query(
    fx.with_sql("f_spans")
    + f""", {_DATES}
SELECT assembly_date, series_id, observation_date, value, realtime_start AS release_date,
       realtime_start AS available_from, least(realtime_end, assembly_date) AS available_through
FROM f_spans JOIN dates ON assembly_date BETWEEN realtime_start AND realtime_end"""
)
def pit_asof_all_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pit.as_of(fx.spans(spark, sf_dir), release_dates(spark, sf_dir))
    return found.select(
        "assembly_date", "series_id", "observation_date", "value", "release_date", "available_from", "available_through"
    )


@query(
    fx.with_sql("f_spans")
    + """
SELECT series_id, ((year(observation_date)) * 12 + month(observation_date) - 1)::INT AS month_idx, value
FROM f_spans WHERE DATE '2018-06-30' BETWEEN realtime_start AND realtime_end"""
)
def pit_asof_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.sql("select date'2018-06-30' as assembly_date")
    found = pit.as_of(fx.spans(spark, sf_dir), one)
    return found.select("series_id", V.month_of(F.col("observation_date")).alias("month_idx"), "value")


@query(
    fx.with_sql("f_releases")
    + """
SELECT series_id, observation_date, max(effective_date) AS effective_date, arg_max(value, effective_date) AS value
FROM f_releases WHERE effective_date <= DATE '2018-06-30' GROUP BY 1, 2"""
)
def pit_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.releases(spark, sf_dir)
    return pit.latest_version(
        rows, ["series_id", "observation_date"], ["effective_date"], F.col("effective_date") <= F.lit("2018-06-30").cast("date")
    ).select("series_id", "observation_date", "effective_date", "value")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but one series are covered through the middle of their releases."""
    rows = fx.releases(spark, sf_dir).where("series_id <> '5-LOW'")
    return rows.groupBy("series_id").agg(F.add_months(F.max("effective_date"), -12).alias("complete_through"))


_COVERAGE = (
    fx.with_sql("f_releases")
    + f""", {_DATES}, coverage AS (
  SELECT series_id, (max(effective_date) - INTERVAL 12 MONTH)::DATE AS complete_through
  FROM f_releases WHERE series_id <> '5-LOW' GROUP BY 1
), asked AS (SELECT * FROM (SELECT DISTINCT series_id FROM f_releases), dates)"""
)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct()
    return release_dates(spark, sf_dir).crossJoin(series)  # five series


@query(
    _COVERAGE
    + """
SELECT series_id, assembly_date,
       CASE WHEN complete_through IS NULL THEN 'no_coverage' WHEN assembly_date > complete_through THEN 'beyond_coverage' END AS reason,
       complete_through IS NOT NULL AND assembly_date <= complete_through AS covered
FROM asked LEFT JOIN coverage USING (series_id)"""
)
def coverage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pit.guard_coverage(_asked(spark, sf_dir), _coverage(spark, sf_dir))
    return found.select("series_id", "assembly_date", "reason", "covered")


@query(_COVERAGE + " SELECT DISTINCT series_id FROM asked WHERE series_id NOT IN (SELECT series_id FROM coverage)")
def coverage_missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).join(_coverage(spark, sf_dir), "series_id", "left_anti").select("series_id").distinct()


@query(
    fx.with_sql("f_releases")
    + """, coverage AS (SELECT series_id, (max(effective_date) + INTERVAL 1 MONTH)::DATE AS complete_through FROM f_releases GROUP BY 1)
SELECT series_id, observation_date, value, effective_date AS realtime_start,
       coalesce(lead(effective_date) OVER (PARTITION BY series_id, observation_date ORDER BY effective_date) - 1,
                complete_through) AS realtime_end
FROM f_releases JOIN coverage USING (series_id)"""
)
def span_scd2_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.releases(spark, sf_dir)
    coverage = rows.groupBy("series_id").agg(F.add_months(F.max("effective_date"), 1).alias("complete_through"))
    built = pit.build_spans(rows, coverage)
    return built.select("series_id", "observation_date", "value", "realtime_start", "realtime_end")


@query(
    fx.with_sql("f_spans")
    + f""", {_DATES}, pit AS (
  SELECT assembly_date, series_id, observation_date, realtime_start AS available_from, least(realtime_end, assembly_date) AS through,
         (year(observation_date) * 12 + month(observation_date)) % 9 AS kind
  FROM f_spans JOIN dates ON assembly_date BETWEEN realtime_start AND realtime_end
), v AS (
  SELECT assembly_date, observation_date, series_id AS asked, CASE WHEN kind = 1 THEN 'other' ELSE series_id END AS series_id,
         CASE WHEN kind IN (4, 5, 6) THEN 'archive' ELSE 'alfred' END AS source, CASE WHEN kind = 2 THEN observation_date - 1 ELSE available_from END AS release_date,
         available_from, through, CASE WHEN kind = 3 THEN 'guessed' ELSE 'observed' END AS basis,
         CASE WHEN kind = 4 THEN 'preliminary' WHEN kind IN (5, 6) THEN 'final' END AS stage,
         CASE WHEN kind = 5 THEN strftime(available_from - 1, '%Y-%m-%dT00:00:00Z') WHEN kind = 6 THEN 'soon' WHEN kind = 4 THEN strftime(available_from, '%Y-%m-%dT00:00:00Z') END AS got
  FROM pit
)
SELECT assembly_date, asked AS series_id, observation_date, array_to_string(list_filter([
  CASE WHEN series_id <> asked THEN 'other_series' END,
  CASE WHEN source <> 'alfred' THEN 'other_source' END,
  CASE WHEN release_date < observation_date THEN 'released_before_observation' END,
  CASE WHEN release_date > assembly_date THEN 'released_after_assembly' END,
  CASE WHEN through <> assembly_date THEN 'not_available_at_assembly' END,
  CASE WHEN available_from < release_date THEN 'available_before_release' END,
  CASE WHEN basis = 'guessed' THEN 'unknown_basis' END,
  CASE WHEN stage = 'preliminary' THEN 'stage_not_allowed' END,
  CASE WHEN got = 'soon' THEN 'invalid_retrieval' END,
  CASE WHEN got LIKE '%Z' AND release_date > got[1:10]::DATE THEN 'released_after_retrieval' END,
  CASE WHEN got LIKE '%Z' AND available_from <> greatest(release_date, got[1:10]::DATE) THEN 'wrong_availability' END
], lambda x: x IS NOT NULL), ',') AS codes FROM v"""
)
def snapshot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pit.as_of(fx.spans(spark, sf_dir), release_dates(spark, sf_dir))
    kind = (V.month_of(F.col("observation_date")) + 1) % 9
    stamp = lambda day: F.date_format(day, "yyyy-MM-dd'T00:00:00Z'")
    values = rows.withColumn("kind", kind).select(
        "assembly_date",
        F.col("series_id").alias("asked_series"),
        F.when(F.col("kind") == 1, "other").otherwise(F.col("series_id")).alias("series_id"),
        F.when(F.col("kind").isin(4, 5, 6), "archive").otherwise("alfred").alias("source"),
        F.lit("alfred").alias("known_source"),
        "observation_date",
        F.when(F.col("kind") == 2, F.date_sub("observation_date", 1)).otherwise(F.col("release_date")).alias("release_date"),
        "available_from",
        "available_through",
        F.when(F.col("kind") == 3, "guessed").otherwise("observed").alias("availability_basis"),
        F.when(F.col("kind") == 4, "preliminary").when(F.col("kind").isin(5, 6), "final").alias("release_stage"),
        F.when(F.col("kind") == 5, stamp(F.date_sub("available_from", 1)))
        .when(F.col("kind") == 6, "soon")
        .when(F.col("kind") == 4, stamp(F.col("available_from")))
        .alias("retrieved_at"),
    )
    found = pit.snapshot_issues(values)
    return found.select("assembly_date", F.col("asked_series").alias("series_id"), "observation_date", F.array_join("codes", ",").alias("codes"))


# --- keyed sinks -----------------------------------------------------------------------------------------------------


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 2 = 0").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice")
    )


_OLD_NEW = """WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'R' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"""


@query(
    _OLD_NEW
    + """
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey,
       coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return pit.upsert(old, new, keys=("o_orderkey",), preserve=("o_custkey",))


@query(
    _OLD_NEW
    + """
SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)"""
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return pit.insert_ignore(old, new, ["o_orderkey"])


@query(
    """WITH a AS (SELECT o_custkey, max(o_orderdate) AS mark FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
b AS (SELECT o_custkey, max(o_orderdate) AS mark FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, greatest(a.mark, b.mark) AS mark FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""
)
def watermark_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("mark"))
    old = orders.where("o_orderkey % 3 <> 0").groupBy("o_custkey").agg(F.max("mark").alias("mark"))
    return pit.advance(old, orders.where("o_orderkey % 2 = 0"), "o_custkey", "mark")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(ts, event_id) AS ts FROM events GROUP BY 1, 2")
def latest_run_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return pit.latest_version(rows, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "ts")


# --- transforms and scores -------------------------------------------------------------------------------------------


@query(
    fx.with_sql("f_weekly")
    + """, m AS (
  SELECT series, (year(wed) * 12 + month(wed) - 1)::INT AS month_idx, avg(value) AS value, count(DISTINCT wed)::INT AS weeks,
         any_value(wed) AS one
  FROM f_weekly GROUP BY 1, 2)
SELECT series, month_idx, round_even(value, 6) AS value, weeks FROM m
WHERE weeks = (SELECT count(*) FROM range(date_trunc('month', one)::TIMESTAMP, (date_trunc('month', one) + INTERVAL 1 MONTH)::TIMESTAMP, INTERVAL 1 DAY) t(d)
               WHERE isodow(d) = 3)"""
)
def weekly_complete_month_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.complete_month_means(fx.weekly(spark, sf_dir), ["series"], "wed", "value")
    return found.select("series", "month_idx", F.bround("value", 6).alias("value"), "weeks")


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 100.0 - value WHEN 'view' THEN -value ELSE value END AS level,
       CASE event_type WHEN 'click' THEN 'hundred_minus_level' WHEN 'view' THEN 'inverted_level' ELSE 'level' END AS transform
FROM events WHERE value IS NOT NULL"""
)
def level_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "events").where("value is not null")
    tag = F.when(F.col("event_type") == "click", "hundred_minus_level").when(F.col("event_type") == "view", "inverted_level").otherwise("level")
    rows = rows.withColumn("transform", tag)
    return rows.select("event_id", transforms.level(F.col("transform"), F.col("value")).alias("level"), "transform")


@query(
    r"""WITH t AS (
  SELECT event_id, user_id AS series_id, ts::DATE AS observation_date,
         CASE event_id % 7 WHEN 0 THEN '.' WHEN 1 THEN 'NaN' WHEN 2 THEN ' 1' ELSE json_extract_string(props, '$.k') END AS value_text
  FROM events)
SELECT event_id, CASE WHEN code IS NULL THEN value_text::DOUBLE END AS number, code FROM (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY series_id, observation_date) > 1 THEN 'duplicate_observation'
                 WHEN value_text = '.' THEN 'missing_value'
                 WHEN value_text IS NULL OR NOT regexp_full_match(value_text, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'invalid_value' END AS code
  FROM t)"""
)
def numeric_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("series_id"),
        F.to_date("ts").alias("observation_date"),
        F.expr("case event_id % 7 when 0 then '.' when 1 then 'NaN' when 2 then ' 1' else get_json_object(props, '$.k') end").alias("value_text"),
    )
    return transforms.numeric_issues(rows, ["series_id"]).select("event_id", "number", "code")


@query(
    fx.with_sql("f_monthly")
    + """, p AS (
  SELECT series, month_idx, value, first_value(value) OVER (PARTITION BY series ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS prior
  FROM f_monthly)
SELECT series, month_idx, round_even(-(value - prior) / prior, 6) AS growth FROM p WHERE prior IS NOT NULL"""
)
def yoy_growth_exact_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.yoy_growth(fx.monthly(spark, sf_dir), ["series"])
    return found.select("series", "month_idx", F.bround("growth", 6).alias("growth"))


@query(
    fx.with_sql("f_pool")
    + """, p AS (
  SELECT *, first_value(value) OVER (PARTITION BY family, member ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS prior
  FROM f_pool)
SELECT family, month_idx, round_even(-(sum(value) - sum(prior)) / sum(prior), 6) AS growth
FROM p GROUP BY 1, 2 HAVING count(prior) = 2"""
)
def pooled_yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.pooled_yoy(fx.pool(spark, sf_dir), ["family"], "member", 2)
    return found.select("family", "month_idx", F.bround("growth", 6).alias("growth"))


@query(
    fx.with_sql("f_z")
    + """
SELECT series, month_idx, n_refs, round_even(z, 6) AS z,
       CASE WHEN n_refs < 36 THEN 'insufficient_history:' || n_refs || '<36' END AS reason FROM f_z"""
)
def trailing_z_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.trailing_z(fx.monthly(spark, sf_dir), ["series"])
    return found.select("series", "month_idx", "n_refs", F.bround("z", 6).alias("z"), "reason")


@query(
    fx.with_sql("f_z")
    + """
SELECT series, max(month_idx) AS month_idx, round_even(arg_max(coalesce(z, 99), month_idx), 6) AS z FROM f_z GROUP BY 1"""
)
def trailing_z_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.last_points(transforms.trailing_z(fx.monthly(spark, sf_dir), ["series"]), ["series"])
    return found.select("series", "month_idx", F.bround(F.coalesce("z", F.lit(99.0)), 6).alias("z"))


@query(
    fx.with_sql("f_quarterly")
    + """, q AS (SELECT component, quarter_idx * 3 AS month_idx, level AS value FROM f_quarterly)
SELECT component, month_idx,
       round_even(CASE WHEN count(value) OVER w >= 20 AND stddev_pop(value) OVER w > 0
            THEN greatest(least((value - avg(value) OVER w) / stddev_pop(value) OVER w, 3.0), -3.0) END, 6) AS z
FROM q WINDOW w AS (PARTITION BY component ORDER BY month_idx RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING)"""
)
def quarterly_z_min20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.quarterly(spark, sf_dir).select("component", (F.col("quarter_idx") * 3).alias("month_idx"), F.col("level").alias("value"))
    found = transforms.trailing_z(rows, ["component"], minimum=transforms.MIN_QUARTERLY)
    return found.select("component", "month_idx", F.bround("z", 6).alias("z"))


@query(
    fx.with_sql("f_spans")
    + f""", {_DATES}, newest AS (
  SELECT assembly_date, series_id, max(realtime_start) AS newest_release
  FROM f_spans JOIN dates ON assembly_date BETWEEN realtime_start AND realtime_end GROUP BY 1, 2)
SELECT assembly_date, series_id, (assembly_date - newest_release)::INT AS age_days, assembly_date - newest_release > 40 AS stale,
       CASE WHEN assembly_date - newest_release > 40 THEN 'stale' END AS reason FROM newest"""
)
def staleness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pit.as_of(fx.spans(spark, sf_dir), release_dates(spark, sf_dir))
    aged = transforms.staleness(found, ["assembly_date", "series_id"], "assembly_date", F.lit(40))
    return aged.select("assembly_date", "series_id", "age_days", "stale", "reason")


# --- calendar --------------------------------------------------------------------------------------------------------

_CLOSED = ", ".join(f"(DATE '{d}')" for d in calendar.closures())
OPEN_DAYS = f"""WITH closed(d) AS (VALUES {_CLOSED}),
days AS (SELECT d::DATE AS day FROM range(TIMESTAMP '2013-01-01', TIMESTAMP '2028-01-01', INTERVAL 1 DAY) t(d)),
open_days AS (SELECT day FROM days WHERE isodow(day) < 6 AND day NOT IN (SELECT d FROM closed)),
rolled AS (SELECT f.day AS friday, min(o.day) AS assembly_date FROM days f JOIN open_days o ON o.day BETWEEN f.day AND f.day + 6
           WHERE isodow(f.day) = 5 GROUP BY 1)"""


@query(OPEN_DAYS + " SELECT friday, assembly_date FROM rolled")
def calendar_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.assemblies(spark)


@query(
    OPEN_DAYS
    + """
SELECT (year(assembly_date) * 12 + month(assembly_date) - 3)::INT AS month_idx, min(assembly_date) AS finalized_on
FROM rolled WHERE day(assembly_date) >= 15 GROUP BY 1"""
)
def month_finalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.finalizations(spark).select("month_idx", "finalized_on")
