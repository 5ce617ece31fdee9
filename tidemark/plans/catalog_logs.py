"""Registered queries of the store's merge log and of incremental algorithms over revisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import month_of, month_start
from tidemark.operators import ranks, revisions
from tidemark.operators.pit import FOREVER
from tidemark.plans import checker, composite, revision_scores
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import query, release_dates
from tidemark.plans.catalog_scores import _ALL, _COVERED, _FROZEN, _composite
from tidemark.plans.catalog_scores import _banded as banded
from tidemark.plans.catalog_scores import _every_date as every_date
from tidemark.session import cut, shared_folder
from tidemark.sources.store import VintageStore
from tidemark.streaming import dwell, held, sink

#: Batches of the merge-log queries: the lines of an order by their number.
BATCHES = range(1, 8)


def _store(spark: SparkSession) -> VintageStore:
    return VintageStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _batch(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Spans of one batch: shipments by status and day, made known in that month or some forty days later."""
    lines = fx.read(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n)
    day = F.to_date("l_shipdate")
    known = F.trunc(F.date_add(day, (40 * (F.col("l_partkey") % 2)).cast("int")), "MM")
    keys = [F.concat("l_returnflag", "l_linestatus").alias("series_id"), day.alias("observation_date"), known.alias("realtime_start")]
    fetched = F.timestamp_seconds(F.lit(n))
    return lines.groupBy(*keys).agg(
        F.max(F.date_add(day, (F.col("l_suppkey") % 400).cast("int"))).alias("realtime_end"),
        F.max("l_orderkey").cast("string").alias("value_text"),
        F.lit(f"batch {n}").alias("source"),
        F.lit(None).cast("string").alias("source_file"),
        fetched.alias("first_fetched_at"),
        fetched.alias("last_fetched_at"),
    )


_LINES = """WITH b AS (
  SELECT l_returnflag || l_linestatus AS series_id, l_shipdate::DATE AS observation_date,
         date_trunc('month', l_shipdate::DATE + (40 * (l_partkey % 2))::INT)::DATE AS realtime_start, l_linenumber AS n,
         max(l_shipdate::DATE + (l_suppkey % 400)::INT) AS realtime_end, max(l_orderkey)::VARCHAR AS value_text
  FROM lineitem GROUP BY ALL)"""


@query(
    _LINES
    + """
SELECT series_id, observation_date, realtime_start, arg_max(realtime_end, n) AS realtime_end, arg_max(value_text, n) AS value_text,
       'batch ' || min(n) AS source, min(n)::BIGINT AS first_batch, max(n)::BIGINT AS last_batch
FROM b GROUP BY ALL"""
)
def merge_log_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts of seven batches, a compaction among them, read back as one table."""
    store = _store(spark)
    for n in BATCHES:
        store.upsert_spans(_batch(spark, sf_dir, n))
        if n == 4:
            store.compact("observation_spans")
    return store.table("observation_spans").select(
        "series_id", "observation_date", "realtime_start", "realtime_end", "value_text", "source",
        F.unix_seconds("first_fetched_at").alias("first_batch"), F.unix_seconds("last_fetched_at").alias("last_batch"),
    )


@query(_LINES + " SELECT series_id, realtime_start AS vintage_date, min(n)::BIGINT AS first_batch FROM b GROUP BY ALL")
def merge_log_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintages of seven batches; what is known already is ignored."""
    store = _store(spark)
    for n in BATCHES:
        rows = _batch(spark, sf_dir, n).select("series_id", F.col("realtime_start").alias("vintage_date"), F.col("first_fetched_at").alias("fetched_at"))
        store.insert_vintages(rows)
    return store.table("vintage_dates").select("series_id", "vintage_date", F.unix_seconds("fetched_at").alias("first_batch"))


@query(
    _LINES
    + """, m AS (SELECT series_id, n, max(realtime_start) - (30 * n)::INT AS complete_through FROM b GROUP BY 1, 2)
SELECT series_id, max(complete_through) AS complete_through, max(n)::BIGINT AS last_batch FROM m GROUP BY 1"""
)
def merge_log_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that would go back from batch to batch; the merged ones never do."""
    store = _store(spark)
    for n in BATCHES:
        marks = _batch(spark, sf_dir, n).groupBy("series_id").agg(
            F.date_sub(F.max("realtime_start"), 30 * n).alias("complete_through"), F.max("last_fetched_at").alias("last_backfill_at")
        )
        store.advance_coverage(marks)
    return store.table("series_coverage").select("series_id", "complete_through", F.unix_seconds("last_backfill_at").alias("last_batch"))


# --- scores from revisions -------------------------------------------------------------------------------------------

#: Every ninth month is taken back at its last revision, so that the latest month goes back now and then.
_REVISED = """, r AS (SELECT series_id, (year(observation_date) * 12 + month(observation_date) - 1)::INT AS month_idx, realtime_start, realtime_end, value
  FROM f_spans), known AS (SELECT * FROM r WHERE NOT (month_idx % 9 = 0 AND realtime_end = DATE '9999-12-31'))"""
_DATES = "dates AS (SELECT DISTINCT date_trunc('month', l_shipdate + INTERVAL 240 MONTH)::DATE AS assembly_date FROM lineitem)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fx.spans(spark, sf_dir).withColumn("month_idx", month_of(F.col("observation_date")))
    return spans.where(~((F.col("month_idx") % 9 == 0) & (F.col("realtime_end") == F.lit(FOREVER).cast("date"))))


@query(
    fx.with_sql("f_spans")
    + _REVISED
    + f""", {_DATES}, held AS (SELECT assembly_date, series_id, month_idx, value FROM known JOIN dates ON assembly_date BETWEEN realtime_start AND realtime_end),
z AS (SELECT *, count(value) OVER w AS n_refs, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sigma,
             row_number() OVER (PARTITION BY assembly_date, series_id ORDER BY month_idx DESC) AS newest
      FROM held WINDOW w AS (PARTITION BY assembly_date, series_id ORDER BY month_idx RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING))
SELECT assembly_date, series_id, month_idx, n_refs, CASE WHEN n_refs < 36 THEN 'insufficient_history:' || n_refs || '<36' END AS reason,
       CASE WHEN n_refs >= 36 THEN round_even(greatest(least((value - mean) / sigma, 3.0), -3.0), 6) END AS z
FROM z WHERE newest = 1"""
)
def trailing_z_by_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each series' latest month at every date of a release, from signed changes alone."""
    found = revisions.trailing_scores(_known(spark, sf_dir), release_dates(spark, sf_dir), ["series_id"], places=2)
    return found.select("assembly_date", "series_id", "month_idx", "n_refs", "reason", F.bround("z", 6).alias("z"))


@query(_composite(_ALL) + " SELECT assembly_date, unit, month_idx, n_refs, round_even(z, 5) AS z FROM scored")
def composite_scores_by_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit's score at every weekly assembly, from vintages to z, without copying histories to dates."""
    spans = composite.demo_spans(spark, sf_dir)
    found = revision_scores.unit_scores(spans, every_date(spark, spans))
    return found.select("assembly_date", "unit", "month_idx", "n_refs", F.bround("z", 5).alias("z"))


# --- order statistics of long panels ---------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, count(*) OVER w AS reference_count,
  quantile_cont(l_extendedprice::DOUBLE, 0.7) OVER w AS p70, quantile_cont(l_extendedprice::DOUBLE, 0.85) OVER w AS p85, quantile_cont(l_extendedprice::DOUBLE, 0.95) OVER w AS p95
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, reference_count, round_even(p70, 4) AS p70, round_even(p85, 4) AS p85, round_even(p95, 4) AS p95 FROM p"""
)
def expanding_percentile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all earlier prices of a return flag, for every line: three panels of a third of the table."""
    rows = fx.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    found = ranks.expanding_percentiles(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice")
    return found.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "reference_count", *[F.bround(f"p{q}", 4).alias(f"p{q}") for q in (70, 85, 95)])


# --- streams ---------------------------------------------------------------------------------------------------------


@query(
    _FROZEN
    + """ SELECT series, month_idx, raw_band, confirmed_band,
       CASE WHEN raw_band IS NOT NULL AND raw_band IS DISTINCT FROM confirmed_band THEN raw_band END AS candidate_band,
       (CASE WHEN raw_band IS NOT NULL AND raw_band IS DISTINCT FROM confirmed_band THEN run ELSE 0 END)::INT AS candidate_count,
       CASE WHEN raw_band IS NOT NULL THEN confirmed_band END AS published_band FROM dwelt"""
)
def dwell_stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of ``dwell_state`` from a stream: even months arrive after odd ones, it is restarted in the middle, and the last
    third is taken by another stream that goes on from what is frozen."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    months = banded(spark, sf_dir).select(
        F.col("series").alias("panel"), "month_idx", "raw_band", month_start(F.col("month_idx")).cast("timestamp").alias("finalized_at")
    )
    months = cut(months.withColumn("part", F.ntile(3).over(Window.partitionBy("panel").orderBy("month_idx")) - 1))
    names = ["panel", "month_idx", "raw_band", "finalized_at"]
    clock = months.select(F.lit("~").alias("panel"), F.lit(None).cast("int").alias("month_idx"), F.lit(None).cast("string").alias("raw_band"), F.max("finalized_at").over(Window.partitionBy()).alias("finalized_at")).limit(1)
    log = sink.MonthLog(spark, f"{folder}/out", dwell.OUTPUT)

    def arrive(rows: DataFrame) -> None:
        rows.select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    for part, stream in enumerate(("one", "one", "two")):
        for odd in (1, 0):
            arrive(months.where((F.col("part") == part) & (F.col("month_idx") % 2 == odd)))
        if part == 2:  # event time goes on, so that all months are past it
            for years in (1, 2):
                arrive(clock.withColumn("finalized_at", F.col("finalized_at") + F.make_interval(F.lit(years))))
        source = spark.readStream.schema(months.select(*names).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        frozen = cut(log.read()) if part == 2 else None
        with held.state_store(spark):
            found = held.held_dwell(source, delay="120 days", frozen=frozen)
            run = found.writeStream.foreachBatch(log.writer(stream)).option("checkpointLocation", f"{folder}/{stream}").trigger(availableNow=True).start()
            run.awaitTermination()
    return log.read().withColumnRenamed("panel", "series")


# --- the second path with modes ---------------------------------------------------------------------------------------


@query(
    _composite(_ALL, guarded=True)
    + " SELECT assembly_date, family, round_even(z, 6) + 0.0 AS z, abstained, flags, releases, 0 AS differences FROM families"
)
def guarded_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family at every assembly by the second path, on spans of both modes under coverage, and how often the first differs."""
    spans = composite.with_provenance(composite.demo_spans(spark, sf_dir))
    dates = cut(every_date(spark, spans))
    coverage = spark.createDataFrame(list(_COVERED.items()), "series_id string, d string").select("series_id", F.to_date("d").alias("complete_through"))
    found = cut(checker.recompute(spans, dates, coverage=coverage))
    wrong, _ = checker.verify(composite.families(spans, dates, coverage=coverage), spans, dates, coverage=coverage)
    n = wrong.agg(F.count(F.lit(1)).cast("int").alias("differences"))
    rows = composite.rounded(found, "z").withColumns({"flags": F.array_join("flags", ","), "releases": F.to_json("releases")})
    return rows.crossJoin(F.broadcast(n))  # one row
