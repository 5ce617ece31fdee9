"""Vintage-aware series derived from the order tables, each with the same rows as DuckDB SQL.

Order and ship dates are moved on by twenty years, into the years that the calendar covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import month_of
from tidemark.operators.pit import FOREVER

SHIFT_MONTHS = 240


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shifted(day: str) -> Column:
    return F.add_months(F.to_date(day), SHIFT_MONTHS)


def money(name: str) -> Column:
    """Decimal sums are exact, so their doubles don't depend on the order of rows."""
    return F.sum(F.col(name).cast("decimal(18,2)"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, month_idx, value): order totals by priority and month."""
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), month_of(shifted("o_orderdate")).alias("month_idx")).agg(
        money("o_totalprice").cast("double").alias("value")
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, member, month_idx, value): two members of one family, by order status."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    return orders.groupBy(
        F.col("o_orderpriority").alias("family"),
        F.col("o_orderstatus").alias("member"),
        month_of(shifted("o_orderdate")).alias("month_idx"),
    ).agg(money("o_totalprice").cast("double").alias("value"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, wed, value): shipped prices by return flag and the Wednesday of the week."""
    items = read(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N')")
    monday = F.to_date(F.date_trunc("week", shifted("l_shipdate")))
    return items.groupBy(F.col("l_returnflag").alias("series"), F.date_add(monday, 2).alias("wed")).agg(
        money("l_extendedprice").cast("double").alias("value")
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, observation_date, effective_date, value): what was shipped by then of a month's orders."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    sums = joined.groupBy(
        F.col("o_orderpriority").alias("series_id"),
        F.trunc(shifted("o_orderdate"), "MM").alias("observation_date"),
        F.trunc(shifted("l_shipdate"), "MM").alias("effective_date"),
    ).agg(money("l_extendedprice").alias("part"))
    so_far = Window.partitionBy("series_id", "observation_date").orderBy("effective_date")
    total = F.sum("part").over(so_far.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return sums.withColumn("value", total).drop("part")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The releases as validity spans; the last of each observation is open."""
    rows = releases(spark, sf_dir)
    following = F.lead("effective_date").over(Window.partitionBy("series_id", "observation_date").orderBy("effective_date"))
    return rows.select(
        "series_id",
        "observation_date",
        F.col("effective_date").alias("realtime_start"),
        F.coalesce(F.date_sub(following, 1), F.lit(FOREVER).cast("date")).alias("realtime_end"),
        "value",
    )


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, quarter_idx, level): order totals by status and quarter."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    quarter = F.floor(month_of(shifted("o_orderdate")) / 3).cast("int")
    return orders.groupBy(F.col("o_orderstatus").alias("component"), quarter.alias("quarter_idx")).agg(
        money("o_totalprice").cast("double").alias("level")
    )


_MONTH = "((year({0}) + 20) * 12 + month({0}) - 1)::INT"
SQL = {
    "f_monthly": f"""f_monthly AS (
  SELECT o_orderpriority AS series, {_MONTH.format('o_orderdate')} AS month_idx,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value
  FROM orders GROUP BY 1, 2)""",
    "f_pool": f"""f_pool AS (
  SELECT o_orderpriority AS family, o_orderstatus AS member, {_MONTH.format('o_orderdate')} AS month_idx,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3)""",
    "f_weekly": """f_weekly AS (
  SELECT l_returnflag AS series, date_trunc('week', l_shipdate + INTERVAL 240 MONTH)::DATE + 2 AS wed,
         sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value
  FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2)""",
    "f_releases": """f_sums AS (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate + INTERVAL 240 MONTH)::DATE AS observation_date,
         date_trunc('month', l_shipdate + INTERVAL 240 MONTH)::DATE AS effective_date,
         sum(l_extendedprice::DECIMAL(18,2)) AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1, 2, 3
), f_releases AS (
  SELECT series_id, observation_date, effective_date,
         (sum(part) OVER (PARTITION BY series_id, observation_date ORDER BY effective_date
                          ROWS UNBOUNDED PRECEDING))::DOUBLE AS value
  FROM f_sums)""",
    "f_quarterly": f"""f_quarterly AS (
  SELECT o_orderstatus AS component, ({_MONTH.format('o_orderdate')} // 3)::INT AS quarter_idx,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS level
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)""",
}
SQL["f_spans"] = (
    SQL["f_releases"]
    + """, f_spans AS (
  SELECT series_id, observation_date, effective_date AS realtime_start,
         coalesce(lead(effective_date) OVER (PARTITION BY series_id, observation_date ORDER BY effective_date) - 1,
                  DATE '9999-12-31') AS realtime_end, value
  FROM f_releases)"""
)
SQL["f_z"] = (
    SQL["f_monthly"]
    + """, f_z AS (
  SELECT series, month_idx, value, count(value) OVER w AS n_refs,
         CASE WHEN count(value) OVER w >= 36 AND stddev_pop(value) OVER w > 0
              THEN greatest(least((value - avg(value) OVER w) / stddev_pop(value) OVER w, 3.0), -3.0) END AS z
  FROM f_monthly WINDOW w AS (PARTITION BY series ORDER BY month_idx RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING))"""
)


def with_sql(*names: str) -> str:
    """A WITH clause of these fixtures."""
    return "WITH " + ", ".join(SQL[n] for n in names)
