"""Registered queries of bands, outcomes, signals, baselines and comparisons."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions import values as V
from tidemark.functions.canonical import canonical_bytes
from tidemark.operators import autoregression, bands, baselines, compare, compose, outcomes, pit, transforms
from tidemark.plans import checker, composite
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import OPEN_DAYS, query
from tidemark.registry import REGISTRY
from tidemark.session import cut
from tidemark.sources import archive, frozen, store

CONTRACT = baselines.Contract()


# --- families and tiers ----------------------------------------------------------------------------------------------


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected members of each family and month: a missing month or one of low total is flagged."""
    pool = fx.pool(spark, sf_dir)
    months = pool.select("family", "month_idx").distinct()
    expected = months.crossJoin(spark.createDataFrame([(1, "F"), (2, "O")], "ord int, member string"))
    joined = expected.join(pool, ["family", "month_idx", "member"], "left")
    return joined.select(
        "family",
        "month_idx",
        "ord",
        F.col("member").alias("series_id"),
        F.col("value").isNull().alias("is_missing"),
        F.lit(False).alias("is_invalid"),
        F.coalesce(F.col("value") < 100_000, F.lit(False)).alias("is_stale"),
    )


@query(
    fx.with_sql("f_pool")
    + """, e AS (SELECT family, month_idx, ord, member FROM (SELECT DISTINCT family, month_idx FROM f_pool), (VALUES (1, 'F'), (2, 'O')) m(ord, member)),
x AS (SELECT e.*, CASE WHEN value IS NULL THEN 'missing_member:' || member WHEN value < 100000 THEN 'stale_member:' || member END AS flag
      FROM e LEFT JOIN f_pool USING (family, month_idx, member))
SELECT family, month_idx, coalesce(string_agg(flag, ',' ORDER BY ord), '') AS flags, count(flag) > 0 AS abstained, count(*) AS n_members
FROM x GROUP BY 1, 2"""
)
def family_gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compose.gate(_members(spark, sf_dir), ["family", "month_idx"])
    return found.select("family", "month_idx", F.array_join("flags", ",").alias("flags"), "abstained", "n_members")


@query(
    fx.with_sql("f_z")
    + """
SELECT month_idx, count(z) AS scored, round_even(CASE WHEN count(z) = 5 THEN avg(z) END, 6) AS mean FROM f_z GROUP BY 1"""
)
def overlay_mean_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = transforms.trailing_z(fx.monthly(spark, sf_dir), ["series"])
    found = compose.all_or_nothing_mean(scored, ["month_idx"], "z", 5)
    return found.select("month_idx", "scored", F.bround("mean", 6).alias("mean"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(
        *[F.lit(x) for pair in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), compose.LEADING) for x in pair]
    )
    scored = transforms.trailing_z(fx.monthly(spark, sf_dir), ["series"]).where("series <> '5-LOW'")
    # A family abstains in months that its number picks out, so that all paths of the composite are seen.
    gone = (F.col("month_idx") + F.ascii("series")) % 7 == 0
    return scored.select(
        "month_idx",
        names[F.col("series")].alias("family"),
        F.when(F.col("series") == "2-HIGH", "B").otherwise("A").alias("tier"),
        F.when(~gone, F.col("z")).alias("z"),
    )


@query(
    fx.with_sql("f_z")
    + """, f AS (
  SELECT month_idx, series, CASE WHEN (month_idx + ascii(series)) % 7 <> 0 THEN z END AS z,
         list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], series) AS ord,
         ['census_retail', 'visa_smi', 'household_liquidity', 'umich_top_tercile'][list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], series)] AS family
  FROM f_z WHERE series <> '5-LOW'
), g AS (
  SELECT month_idx, avg(z) FILTER (series <> '2-HIGH') AS a, avg(z) AS every, coalesce(bool_or(z IS NOT NULL) FILTER (series = '2-HIGH'), false) AS has_b,
         4 - count(z) AS n_absent, string_agg(family, ',' ORDER BY ord) FILTER (z IS NULL) AS gone,
         list(family) FILTER (z IS NOT NULL) AS scored
  FROM f GROUP BY 1)
SELECT month_idx, round_even(CASE WHEN n_absent < 2 THEN a END, 6) AS tier_a,
       round_even(CASE WHEN n_absent < 2 AND has_b THEN every END, 6) AS tier_b,
       round_even(CASE WHEN n_absent < 2 THEN CASE WHEN has_b THEN every ELSE a END END, 6) AS headline,
       CASE WHEN n_absent < 2 THEN CASE WHEN has_b THEN 'B' ELSE 'A' END END AS headline_tier, n_absent >= 2 AS abstained,
       concat_ws(',', nullif(array_to_string(list_transform(list_filter(['census_retail', 'visa_smi', 'household_liquidity', 'umich_top_tercile'],
                 lambda x: scored IS NULL OR NOT list_contains(scored, x)), lambda x: 'family_abstention:' || x), ','), ''),
                 CASE WHEN n_absent >= 2 THEN 'leading_abstained:' || n_absent || '_of_4_families'
                      WHEN n_absent > 0 THEN 'leading_renormalized:' || gone END) AS flags
FROM g"""
)
def tier_ab_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compose.tiers(_families(spark, sf_dir), ["month_idx"])
    return found.withColumn("flags", F.array_join("flags", ","))


@query(
    """SELECT o_orderkey, list_contains(CASE WHEN o_orderpriority = '3-MEDIUM' THEN ['umich_internal', 'public'] ELSE ['public'] END, 'umich_internal') AS redacted,
       CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_totalprice END AS transformed_value FROM orders"""
)
def redaction_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.array(F.lit("umich_internal"), F.lit("public"))).otherwise(F.array(F.lit("public"))).alias("licenses"),
        F.col("o_totalprice").alias("transformed_value"),
    )
    return compose.redact(rows).select("o_orderkey", "redacted", "transformed_value")


# --- bands -----------------------------------------------------------------------------------------------------------

#: A burn-in that the 80 months at hand can pass.
_BURN = 12
_FROZEN = (
    fx.with_sql("f_monthly")
    + f""", frozen AS (
  SELECT series, month_idx, round_even((value / 1e6)::DOUBLE, 6) AS frozen, row_number() OVER w AS position,
         (count(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS reference_count,
         list_sort(list((round(round_even((value / 1e6)::DOUBLE, 6) * 1000000))::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS refs
  FROM f_monthly WINDOW w AS (PARTITION BY series ORDER BY month_idx)
), cut AS (
  SELECT series, month_idx, frozen, position, reference_count, position >= {_BURN} AND reference_count >= {_BURN - 1} AS eligible,
         {", ".join(f'''CASE WHEN position >= {_BURN} AND reference_count >= {_BURN - 1} THEN round_even(
           (refs[((len(refs) - 1) * {q} // 100) + 1]::DECIMAL(20,0) * 100
            + (refs[least((len(refs) - 1) * {q} // 100 + 2, len(refs))] - refs[((len(refs) - 1) * {q} // 100) + 1])::DECIMAL(20,0) * ((len(refs) - 1) * {q} % 100)::DECIMAL(3,0)
           )::DECIMAL(24,0) * 0.00000001::DECIMAL(9,8), 6)::DOUBLE END AS p{q}''' for q in (70, 85, 95))}
  FROM frozen
), banded AS (
  SELECT *, CASE WHEN frozen < p70 THEN 'Normal' WHEN frozen < p85 THEN 'Watch' WHEN frozen <= p95 THEN 'Elevated' WHEN frozen > p95 THEN 'High' END AS raw_band
  FROM cut
), runs AS (
  SELECT *, sum(CASE WHEN raw_band = lag_band THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY month_idx) AS run_id
  FROM (SELECT *, lag(raw_band) OVER (PARTITION BY series ORDER BY month_idx) AS lag_band FROM banded)
), counted AS (
  SELECT *, CASE WHEN raw_band IS NOT NULL THEN row_number() OVER (PARTITION BY series, run_id ORDER BY month_idx) END AS run FROM runs
), dwelt AS (
  SELECT *, last_value(CASE WHEN run >= 2 THEN raw_band END IGNORE NULLS) OVER (PARTITION BY series ORDER BY month_idx) AS confirmed_band FROM counted
)"""
)


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.monthly(spark, sf_dir).withColumn("value", F.col("value") / 1e6)
    return bands.raw_band(bands.thresholds(rows, ["series"], burn_in=_BURN, minimum=_BURN - 1))


@query(_FROZEN + " SELECT series, month_idx, reference_count, eligible, p70, p85, p95 FROM cut")
def expanding_percentile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir).select("series", "month_idx", "reference_count", "eligible", "p70", "p85", "p95")


@query(_FROZEN + " SELECT series, month_idx, frozen, raw_band FROM banded")
def band_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir).select("series", "month_idx", "frozen", "raw_band")


@query(
    _FROZEN
    + """ SELECT series, month_idx, raw_band, confirmed_band,
       CASE WHEN raw_band IS NOT NULL AND raw_band IS DISTINCT FROM confirmed_band THEN raw_band END AS candidate_band,
       (CASE WHEN raw_band IS NOT NULL AND raw_band IS DISTINCT FROM confirmed_band THEN run ELSE 0 END)::INT AS candidate_count,
       CASE WHEN raw_band IS NOT NULL THEN confirmed_band END AS published_band FROM dwelt"""
)
def dwell_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bands.dwell(_banded(spark, sf_dir), ["series"])
    return found.select("series", "month_idx", "raw_band", "confirmed_band", "candidate_band", "candidate_count", "published_band")


@query(
    fx.with_sql("f_monthly")
    + """, x AS (SELECT series, month_idx, make_date(month_idx // 12, month_idx % 12 + 1, 15) AS finalized_on FROM f_monthly WHERE month_idx % 11 <> 0),
y AS (SELECT *, lag(month_idx) OVER w AS previous_month, lag(finalized_on) OVER w AS previous_final FROM x WINDOW w AS (PARTITION BY series ORDER BY month_idx))
SELECT series, month_idx, previous_month, CASE WHEN month_idx <> previous_month + 1 THEN 'month_gap' ELSE 'finalization_order' END AS code
FROM y WHERE month_idx <> previous_month + 1 OR finalized_on <= previous_final"""
)
def frozen_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.monthly(spark, sf_dir).where("month_idx % 11 <> 0")
    rows = rows.withColumn("finalized_on", F.date_add(V.month_start(F.col("month_idx")), 14))
    return bands.chain_issues(rows, ["series"]).select("series", "month_idx", "previous_month", "code")


@query(
    _FROZEN
    + """ SELECT series, month_idx, raw_band AS recomputed, CASE WHEN month_idx % 13 = 0 THEN 'Watch' ELSE raw_band END AS stored
FROM banded WHERE raw_band IS DISTINCT FROM CASE WHEN month_idx % 13 = 0 THEN 'Watch' ELSE raw_band END"""
)
def frozen_replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = _banded(spark, sf_dir).select("series", "month_idx", F.col("raw_band").alias("recomputed"))
    stored = again.select(
        "series", "month_idx", F.when(F.col("month_idx") % 13 == 0, "Watch").otherwise(F.col("recomputed")).alias("stored")
    )
    both = again.join(stored, ["series", "month_idx"], "full_outer")
    return both.where(compare.differs(F.col("recomputed"), F.col("stored")))


# --- outcomes and signals --------------------------------------------------------------------------------------------

_GAPS = (
    fx.with_sql("f_quarterly", "f_z")
    + """, gaps AS (
  SELECT component, quarter_idx,
         CASE WHEN count(ln(level)) OVER w = 8 THEN 100.0 * (exp(ln(level) - (regr_intercept(ln(level), quarter_idx) OVER w
              + regr_slope(ln(level), quarter_idx) OVER w * quarter_idx)) - 1.0) END AS gap
  FROM f_quarterly WINDOW w AS (PARTITION BY component ORDER BY quarter_idx RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)
), outcomes AS (
  SELECT coalesce(a.quarter_idx, b.quarter_idx) AS quarter_idx,
         CASE WHEN a.quarter_idx IS NULL OR b.quarter_idx IS NULL THEN 'missing_component'
              WHEN a.gap IS NULL OR b.gap IS NULL THEN 'insufficient_trend_history' END AS reason,
         round_even((a.gap + b.gap) / 2.0, 6) AS gap, (a.gap + b.gap) / 2.0 <= -2.0 + 1e-12 AS event
  FROM (SELECT * FROM gaps WHERE component = 'F') a
  FULL JOIN (SELECT * FROM gaps WHERE component = 'O' AND quarter_idx % 9 <> 0) b ON a.quarter_idx = b.quarter_idx
), leads AS (
  SELECT z.series, z.month_idx, z.z,
         CASE WHEN one.quarter_idx IS NULL OR two.quarter_idx IS NULL THEN 'outcome_unavailable'
              WHEN one.event IS NULL OR two.event IS NULL THEN 'outcome_abstention' END AS outcome_reason,
         one.event AS e1, two.event AS e2
  FROM f_z z LEFT JOIN outcomes one ON one.quarter_idx = z.month_idx // 3 + 1 LEFT JOIN outcomes two ON two.quarter_idx = z.month_idx // 3 + 2
), signals AS (
  SELECT *, CASE WHEN outcome_reason IS NULL THEN e1 OR e2 END AS outcome_event, z > 0.25 AS signal FROM leads
), scores AS (
  SELECT series, month_idx, signal, outcome_event, outcome_reason,
         coalesce(signal, false) AND NOT coalesce(lag(signal) OVER (PARTITION BY series ORDER BY month_idx), false) AS episode_onset,
         CASE WHEN signal IS NULL THEN 'signal_abstention' WHEN outcome_event IS NULL THEN 'outcome_abstention' ELSE 'scored' END AS score_status,
         CASE WHEN signal IS NOT NULL AND outcome_event IS NOT NULL THEN signal AND outcome_event END AS hit,
         CASE WHEN month_idx BETWEEN 24095 AND 24113 OR month_idx BETWEEN 24241 AND 24243 THEN 'recession' ELSE 'expansion' END AS business_cycle,
         CASE WHEN abs(month_idx - 24095) <= 6 OR abs(month_idx - 24113) <= 6 OR abs(month_idx - 24241) <= 6 OR abs(month_idx - 24243) <= 6
              THEN 'turning_point' ELSE 'trend' END AS turning_context
  FROM signals)"""
)
_SUMMARY = """count(*) AS points, count(*) FILTER (score_status = 'scored') AS scorable,
  count(*) FILTER (score_status = 'signal_abstention') AS signal_abstentions,
  count(*) FILTER (score_status = 'outcome_abstention') AS outcome_abstentions, count(*) FILTER (episode_onset) AS episodes,
  count(*) FILTER (episode_onset AND score_status = 'scored') AS scored_episodes,
  count(*) FILTER (episode_onset AND score_status = 'scored' AND hit) AS hits,
  count(*) FILTER (episode_onset AND score_status = 'scored' AND hit) / nullif(count(*) FILTER (episode_onset AND score_status = 'scored'), 0) AS lead_rate"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.trend_gap(fx.quarterly(spark, sf_dir), ["component"])


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _gaps(spark, sf_dir)
    return outcomes.outcome_gaps(found.where("component = 'F'"), found.where("component = 'O' and quarter_idx % 9 <> 0"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = transforms.trailing_z(fx.monthly(spark, sf_dir), ["series"]).select("series", "month_idx", "z")
    found = outcomes.lead_events(scored, _outcomes(spark, sf_dir))
    return outcomes.score_signals(found.withColumn("signal", F.col("z") > 0.25), ["series"])


@query(_GAPS + " SELECT component, quarter_idx, round_even(gap, 6) AS gap FROM gaps")
def outcome_trend_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("component", "quarter_idx", F.bround("gap", 6).alias("gap"))


@query(_GAPS + " SELECT quarter_idx, reason, CASE WHEN reason IS NULL THEN gap END AS gap, CASE WHEN reason IS NULL THEN event END AS event FROM outcomes")
def outcome_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("quarter_idx", "reason", F.bround("gap", 6).alias("gap"), "event")


@query(_GAPS + " SELECT series, month_idx, outcome_event, outcome_reason FROM signals")
def event_next_two_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = fx.monthly(spark, sf_dir).select("series", "month_idx")
    found = outcomes.lead_events(months, _outcomes(spark, sf_dir))
    return found.select("series", "month_idx", "outcome_event", "outcome_reason")


@query(_GAPS + " SELECT series, month_idx, signal, episode_onset, score_status, hit, business_cycle, turning_context FROM scores")
def episode_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "series month_idx signal episode_onset score_status hit business_cycle turning_context"
    return _scores(spark, sf_dir).select(*columns.split())


@query(_GAPS + f" SELECT series, {_SUMMARY} FROM scores GROUP BY 1")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.summarize(_scores(spark, sf_dir), ["series"])


@query(
    _GAPS
    + """, b AS (
  SELECT CASE WHEN z < 0 THEN 'Normal' WHEN z < 0.5 THEN 'Watch' WHEN z < 1 THEN 'Elevated' ELSE 'High' END AS band, outcome_event
  FROM signals WHERE z IS NOT NULL AND outcome_event IS NOT NULL
), t AS (
  SELECT o.ord::INT AS ord, o.band, count(b.band) AS n, count(*) FILTER (outcome_event) AS events,
         count(*) FILTER (outcome_event) / nullif(count(b.band), 0) AS probability
  FROM (VALUES (0, 'Normal'), (1, 'Watch'), (2, 'Elevated'), (3, 'High')) o(ord, band) LEFT JOIN b ON b.band = o.band GROUP BY 1, 2
), f AS (SELECT *, coalesce(lag(probability) OVER (ORDER BY ord) > probability * (1 + 1e-9), false) AS fell FROM t)
SELECT ord, band, n, events, probability,
       CASE WHEN count(probability) OVER () = 4 THEN NOT bool_or(fell) OVER () END AS monotonic FROM f"""
)
def calibration_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scores(spark, sf_dir)
    band = V.classify(F.col("z"), F.lit(0.0), F.lit(0.5), F.lit(0.9999999999))
    return outcomes.calibration(spark, scored.withColumn("band", band))


@query(
    _GAPS
    + f""", long AS (SELECT *, 'business_cycle' AS dimension, business_cycle AS category FROM scores
  UNION ALL SELECT *, 'turning_context', turning_context FROM scores), s AS (SELECT dimension, category, {_SUMMARY} FROM long GROUP BY 1, 2)
SELECT *, CASE WHEN count(lead_rate) OVER (PARTITION BY dimension) = 2 THEN round_even(avg(lead_rate) OVER (PARTITION BY dimension), 6) END AS macro_lead_rate FROM s"""
)
def regime_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.regime_macro(_scores(spark, sf_dir))
    return found.withColumn("macro_lead_rate", F.bround("macro_lead_rate", 6))


# --- baselines -------------------------------------------------------------------------------------------------------

_ORIGINS = (
    fx.with_sql("f_monthly")
    + """, o AS (
  SELECT series, month_idx, list(value) OVER (w ROWS UNBOUNDED PRECEDING) AS h, list(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS actual
  FROM f_monthly WINDOW w AS (PARTITION BY series ORDER BY month_idx)
), f AS (
  SELECT *, CASE WHEN len(h) >= 12 THEN list_transform(range(6), lambda k: h[len(h) - 12 + k % 12 + 1]) END AS forecast FROM o)"""
)


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baselines.origins(fx.monthly(spark, sf_dir), ["series"], "value", CONTRACT.horizon)
    return found.withColumn("forecast", baselines.seasonal_naive(F.col("history"), CONTRACT.horizon))


@query(_ORIGINS + " SELECT series, month_idx, len(h)::INT AS n_history, round_even(forecast[1], 6) AS first, round_even(list_sum(forecast), 4) AS total FROM f")
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("forecast", F.lit(0.0), lambda s, x: s + x)
    return _origins(spark, sf_dir).select(
        "series", "month_idx", F.size("history").alias("n_history"), F.bround(F.get("forecast", F.lit(0)), 6).alias("first"), F.bround(total, 4).alias("total")
    )


@query(
    _ORIGINS
    + """
SELECT series, month_idx, round_even(
  CASE WHEN len(h) > 12 AND len(actual) = 6 THEN
    list_avg(list_transform(range(1, 7), lambda i: abs(actual[i] - forecast[i])))
    / list_avg(list_transform(range(1, len(h) - 11), lambda i: abs(h[i + 12] - h[i]))) END, 6) AS mase FROM f"""
)
def mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = baselines.mase(F.col("history"), F.col("actual"), F.col("forecast"))
    return _origins(spark, sf_dir).select("series", "month_idx", F.bround(error, 6).alias("mase"))


@query(
    _ORIGINS
    + """
SELECT series, month_idx, CASE WHEN forecast IS NOT NULL THEN
  len(list_filter(range(1, 6), lambda i: forecast[i] >= h[len(h)] AND forecast[i + 1] >= h[len(h)])) > 0 END AS signal FROM f"""
)
def path_signal_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.element_at("history", -1)
    signal = F.when(F.col("forecast").isNotNull(), baselines.path_signal(F.col("forecast"), now, CONTRACT.dwell))
    return _origins(spark, sf_dir).select("series", "month_idx", signal.alias("signal"))


def _equations(design: list[str], values: list[str], horizon: int) -> str:
    """CTEs on ``o`` (k, month_idx, n, and the columns named): the forecasts of each row's history, as ``f`` with step 1 to ``horizon``.

    Running sums of products make the augmented matrix; Gauss-Jordan with partial pivoting takes a column a step.
    """
    n, m = len(design), len(design) + len(values)
    lags = len(design) - 1
    return f""", x AS (SELECT k, month_idx, n, [{", ".join(design)}] AS x, [{", ".join([*design, *values])}] AS z FROM o
), long AS (
  SELECT k, month_idx, i, j, sum(CASE WHEN x[{n}] IS NOT NULL THEN x[i] * z[j] END) OVER (PARTITION BY k, i, j ORDER BY month_idx) AS s
  FROM x, (SELECT unnest(range(1, {n + 1})) AS i), (SELECT unnest(range(1, {m + 1})) AS j)
), wide AS (SELECT k, month_idx, i, list(s ORDER BY j) AS r FROM long GROUP BY 1, 2, 3
), start AS (SELECT k, month_idx, list(r ORDER BY i) AS a FROM wide JOIN (SELECT k, month_idx FROM o WHERE n >= {max(CONTRACT.minimum, n + 1)}) USING (k, month_idx) GROUP BY 1, 2
), steps AS (
  SELECT k, month_idx, 1 AS c, a, 1e-12 * greatest(1.0, list_max(list_transform(a, lambda r: list_max(list_transform(r[1:{n}], lambda v: abs(v)))))) AS tiny, true AS fine FROM start
  UNION ALL
  SELECT k, month_idx, c + 1, list_transform(range(1, {n + 1}), lambda r: CASE WHEN r = c THEN lead ELSE
           list_transform(range(1, {m + 1}), lambda q: a[CASE WHEN r = best THEN c ELSE r END][q] - a[CASE WHEN r = best THEN c ELSE r END][c] * lead[q]) END), tiny, fine AND large
  FROM (SELECT *, list_transform(a[best], lambda v: v / a[best][c]) AS lead, abs(a[best][c]) > tiny AS large
        FROM (SELECT *, (c - 1 + list_position(list_transform(a[c:{n}], lambda r: abs(r[c])), list_max(list_transform(a[c:{n}], lambda r: abs(r[c])))))::INT AS best
              FROM steps WHERE c <= {n}))
), solved AS (
  SELECT k, month_idx, list_transform(range({n + 1}, {m + 1}), lambda q: list_transform(a, lambda r: r[q])) AS e, state
  FROM steps JOIN o USING (k, month_idx) WHERE c = {n + 1} AND fine
), path AS (
  SELECT k, month_idx, 0 AS step, e, state, NULL::DOUBLE AS mean FROM solved
  UNION ALL
  SELECT k, month_idx, step + 1, e, list_concat(now, state)[1:{lags}], list_avg(now)
  FROM (SELECT *, list_transform(e, lambda b: b[1] + list_dot_product(b[2:{n}], state)) AS now FROM path WHERE step < {horizon})
), f AS (SELECT k, month_idx, list(mean ORDER BY step) AS f FROM path WHERE step > 0 GROUP BY 1, 2)"""


def _steps(unit: float = 1.0) -> list:
    return [F.bround(F.get("forecast", F.lit(n)) / unit, 4).alias(f"h{n + 1}") for n in range(CONTRACT.horizon)]


_H = ", ".join(f"round_even(f[{n}], 4) AS h{n}" for n in range(1, CONTRACT.horizon + 1))
_REASON = f"CASE WHEN f IS NULL AND n < {CONTRACT.minimum} THEN 'insufficient_history' WHEN f IS NULL THEN 'singular_fit' END AS reason"
_SCALAR_LAGS = [f"lag(value, {k}) OVER w" for k in range(1, CONTRACT.ar_lags + 1)]


@query(
    fx.with_sql("f_monthly").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", o AS (
  SELECT series AS k, month_idx, row_number() OVER w AS n, value, {", ".join(f"{lag} AS l{k}" for k, lag in enumerate(_SCALAR_LAGS, 1))}, [value, {", ".join(_SCALAR_LAGS[:-1])}] AS state
  FROM f_monthly WINDOW w AS (PARTITION BY series ORDER BY month_idx))"""
    + _equations(["1.0::DOUBLE", *[f"l{k}" for k in range(1, CONTRACT.ar_lags + 1)]], ["value"], CONTRACT.horizon)
    + f" SELECT k AS series, month_idx, {_H.replace('round_even(f[', 'round_even(1e-6 * f[')}, {_REASON} FROM o LEFT JOIN f USING (k, month_idx)"
)
def ar_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar autoregressions of each series at every month, in millions."""
    rows = fx.monthly(spark, sf_dir).withColumn("vector", F.array("value"))
    found = autoregression.forecasts(rows, ["series"], "vector", 1, CONTRACT.ar_lags, CONTRACT.horizon, CONTRACT.minimum)
    return found.select("series", "month_idx", *_steps(1e6), "reason")


@query(
    fx.with_sql("f_monthly").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", v AS (SELECT month_idx, list(value / 1e6 ORDER BY series) AS v FROM f_monthly GROUP BY 1 HAVING count(*) = 5
), o AS (SELECT 'all' AS k, month_idx, row_number() OVER w AS n, v, v AS state, lag(v) OVER w AS p FROM v WINDOW w AS (ORDER BY month_idx))"""
    + _equations(["1.0::DOUBLE", *[f"p[{c}]" for c in range(1, 6)]], [f"v[{c}]" for c in range(1, 6)], CONTRACT.horizon)
    + f" SELECT k AS panel, month_idx, {_H}, {_REASON} FROM o LEFT JOIN f USING (k, month_idx)"
)
def var_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector autoregression of all five series at every month that all of them have."""
    wide = fx.monthly(spark, sf_dir).groupBy("month_idx").agg(F.sort_array(F.collect_list(F.struct("series", "value"))).alias("v"))
    wide = wide.where(F.size("v") == 5).select(F.lit("all").alias("panel"), "month_idx", F.transform("v", lambda x: x["value"] / 1e6).alias("vector"))
    found = autoregression.forecasts(wide, ["panel"], "vector", 5, CONTRACT.var_lags, CONTRACT.horizon, CONTRACT.minimum)
    return found.select("panel", "month_idx", *_steps(), "reason")


def _drawn(lengths: tuple[int, ...]) -> str:
    """A table (length, text) of all trials, ten characters each: where the turn starts, then the blocks in their order.

    It is drawn here by the rule of the contract, trial after trial, and not by the code that it is held against.
    """
    import random

    rows = []
    for n in lengths:
        stream, text = random.Random(CONTRACT.seed), []
        for _ in range(CONTRACT.trials):
            while True:
                turn, blocks = stream.randrange(n), list(range(-(-n // CONTRACT.block)))
                stream.shuffle(blocks)
                starts = [sum(min(CONTRACT.block, n - CONTRACT.block * b) for b in blocks[:k]) for k in range(len(blocks))]
                moves = [(turn + CONTRACT.block * b - at) % n for b, at in zip(blocks, starts)]
                if all(min(m, n - m) > CONTRACT.embargo for m in moves):
                    break
            text.append(f"{turn:03d}" + "".join(map(str, blocks)))
        rows.append(f"({n}, '{''.join(text)}')")
    return f"(VALUES {', '.join(rows)}) drawn(length, text)"


#: The months of the tables' orders: all series have one of these numbers of months.
_LENGTHS = (79, 80)


@functools.cache
def permutation_sql() -> str:
    """SQL of ``permutation_null``; a function, as its table of trials takes some seconds to draw."""
    block = CONTRACT.block
    return (
        _GAPS
        + f""", points AS (
  SELECT series, signal, outcome_event, row_number() OVER (PARTITION BY series ORDER BY month_idx) - 1 AS idx, (count(*) OVER (PARTITION BY series))::INT AS length FROM signals
), trials AS (SELECT length, t AS trial, substr(text, 10 * t + 1, 10) AS drawn FROM {_drawn(_LENGTHS)}, range({CONTRACT.trials}) r(t)
), blocks AS (
  SELECT length, trial, substr(drawn, 1, 3)::INT AS turn, k, {block} * substr(drawn, 4 + k::INT, 1)::INT AS start FROM trials, range(7) q(k)
), placed AS (
  SELECT *, least({block}, length - start) AS n, coalesce(sum(least({block}, length - start)) OVER (PARTITION BY length, trial ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
  FROM blocks
), moved AS (
  SELECT length, trial, (at_ + i)::BIGINT AS target, ((turn + start + i) % length)::BIGINT AS source FROM placed, range({block}) s(i) WHERE i < n
), joined AS (
  SELECT a.series, trial, target, a.signal, b.outcome_event FROM moved m JOIN points a ON a.length = m.length AND a.idx = m.source
  JOIN points b ON b.series = a.series AND b.idx = m.target
), onsets AS (
  SELECT series, trial, outcome_event, coalesce(signal, false) AND NOT coalesce(lag(signal) OVER (PARTITION BY series, trial ORDER BY target), false) AS onset FROM joined
), counts AS (
  SELECT series, trial, count(*) FILTER (onset) AS episodes, count(*) FILTER (onset AND outcome_event IS NOT NULL) AS scored_episodes, count(*) FILTER (onset AND outcome_event) AS hits
  FROM onsets GROUP BY 1, 2
)
SELECT series, trial::INT AS trial, episodes, scored_episodes, hits, hits / nullif(scored_episodes, 0) AS lead_rate,
       CASE WHEN scored_episodes = 0 THEN 'no_signal_episode' ELSE 'scored' END AS status FROM counts"""
    )


@query(permutation_sql)
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead rates of each series' signals under joint block permutations: the null of no lead.

    Every series has the contract's trials, from the contract's seed; series of equal length share their table.
    """
    points = _scores(spark, sf_dir).select("series", "month_idx", "signal", "outcome_event")
    order, whole = Window.partitionBy("series").orderBy("month_idx"), Window.partitionBy("series")
    points = points.withColumns({"idx": F.row_number().over(order) - 1, "length": F.count(F.lit(1)).over(whole).cast("int")})
    points = cut(points)
    lengths = points.select("series", "length").distinct()
    table = baselines.permutation_tables(lengths, CONTRACT).join(F.broadcast(lengths), "length").drop("length")  # a row for each series
    source = points.select("series", F.col("idx").alias("source"), "signal")
    target = points.select("series", F.col("idx").alias("target"), "month_idx", "outcome_event")
    moved = table.where("target is not null").join(F.broadcast(source), ["series", "source"]).join(F.broadcast(target), ["series", "target"])
    trials = outcomes.summarize(outcomes.score_signals(moved, ["series", "trial"]), ["series", "trial"])
    every = table.select("series", "trial").distinct().join(trials, ["series", "trial"], "left")
    status = F.when(F.col("points").isNull(), "embargo_abstention").when(F.col("lead_rate").isNull(), "no_signal_episode").otherwise("scored")
    return every.select("series", "trial", "episodes", "scored_episodes", "hits", "lead_rate", status.alias("status"))


# --- comparisons -----------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, sha256('{"key":' || p_partkey || ',"name":"' || p_name || '","price":' || printf('%.6f', p_retailprice) || '}' || chr(10)) AS digest FROM part"""
)
def json_canonical_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "part")
    ordered = F.struct(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("decimal(18,6)").alias("price")
    )
    text = F.concat(F.to_json(ordered, {"ignoreNullFields": "false"}), F.lit("\n"))
    return rows.select("p_partkey", F.sha2(text, 256).alias("digest"))


@query(
    """WITH a AS (SELECT p_partkey AS k, '/size' AS path, p_size::VARCHAR AS v FROM part UNION ALL SELECT p_partkey, '/brand', '"' || p_brand || '"' FROM part),
b AS (SELECT p_partkey AS k, '/size' AS path, (p_size + (p_partkey % 5 = 0)::INT)::VARCHAR AS v FROM part
      UNION ALL SELECT p_partkey, '/brand', '"' || p_brand || '"' FROM part WHERE p_partkey % 7 <> 0)
SELECT a.k AS p_partkey, a.path, CASE WHEN b.k IS NULL THEN 'missing_in_candidate' ELSE 'value_mismatch' END AS code
FROM a LEFT JOIN b ON a.k = b.k AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v"""
)
def json_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "part")
    one = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))
    other = F.to_json(
        F.struct(
            (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("size"),
            F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("brand"),
        )
    )
    a = compare.flatten_json(rows.select("p_partkey", one.alias("t")), "p_partkey", "t")
    b = compare.flatten_json(rows.select("p_partkey", other.alias("t")), "p_partkey", "t")
    return compare.tree_diff(a, b, "p_partkey").select("p_partkey", "path", "code")


@query(
    """WITH old AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0),
new AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'added' WHEN n.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.s_suppkey = n.s_suppkey
WHERE o.s_suppkey IS NULL OR n.s_suppkey IS NULL OR o.s_name IS DISTINCT FROM n.s_name OR o.s_acctbal IS DISTINCT FROM n.s_acctbal"""
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey % 4 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")))
    return compare.changed(rows.where("s_suppkey % 5 <> 0"), new, "s_suppkey")


@query(
    """SELECT o.ord::INT AS ord, o_orderstatus AS label, count(*) AS n FROM orders JOIN (VALUES (0, 'O'), (1, 'F'), (2, 'P'), (3, 'X')) o(ord, label) ON label = o_orderstatus GROUP BY 1, 2"""
)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([(0, "O"), (1, "F"), (2, "P"), (3, "X")], "ord int, label string")
    return compare.label_counts(fx.read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "label"), "label", order)


@query(
    """SELECT o_custkey, CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'ok' ELSE 'degraded' END AS provider_health, sum(o_orderkey % 3)::BIGINT AS rate_limited
FROM orders GROUP BY 1"""
)
def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", "ok").otherwise("failed")
    runs = fx.read(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), (F.col("o_orderkey") % 3).alias("rate_limited"))
    return store.provider_health(runs, ["o_custkey"])


_RANK = "['Verified', 'Provisional', 'Stale', 'Unverified', 'Conflicting']"


@query(f"SELECT o_custkey, {_RANK}[max(o_orderkey % 5) + 1] AS worst FROM orders GROUP BY 1")
def worst_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in V.CONFIDENCE])
    rows = fx.read(spark, sf_dir, "orders").select("o_custkey", F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("label"))
    return rows.groupBy("o_custkey").agg(V.worst_label(F.collect_set("label")).alias("worst"))


@query(
    fx.with_sql("f_monthly")
    + """, x AS (SELECT series, make_date(month_idx // 12, month_idx % 12 + 1, 1) AS observation_date, month_idx FROM f_monthly WHERE month_idx % 5 <> 0
  UNION ALL SELECT series, make_date(month_idx // 12, month_idx % 12 + 1, 1), month_idx FROM f_monthly WHERE month_idx % 17 = 0),
l AS (SELECT *, lag(month_idx) OVER (PARTITION BY series ORDER BY month_idx) AS p FROM x)
SELECT series AS series_id, observation_date, 'gap' AS code FROM l WHERE month_idx - p > 1
UNION ALL SELECT series, observation_date, 'duplicate' FROM x GROUP BY 1, 2 HAVING count(*) > 1"""
)
def gap_duplicate_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.monthly(spark, sf_dir).select(
        F.col("series").alias("series_id"), V.month_start(F.col("month_idx")).alias("observation_date"), "month_idx"
    )
    rows = rows.where("month_idx % 5 <> 0").unionByName(rows.where("month_idx % 17 = 0"))
    late = pit.gaps(rows, F.lit("monthly")).select("series_id", "observation_date", F.lit("gap").alias("code"))
    twice = pit.duplicates(rows, ["series_id", "observation_date"])
    return late.unionByName(twice.select("series_id", "observation_date", F.lit("duplicate").alias("code")))


@query(
    r"""WITH t AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'NOPE' ELSE 'UMICH_SCA_T2N_TOP' END AS series_id,
         CASE o_orderkey % 11 WHEN 0 THEN '2020-1-5' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS observation_date,
         CASE o_orderkey % 13 WHEN 0 THEN ' ' ELSE o_totalprice::VARCHAR END AS value_text,
         strftime(o_orderdate + to_days((o_orderkey % 5 - 1)::INT), '%Y-%m-%d') AS release_date,
         ['preliminary', 'final', 'revision', 'guess'][(o_custkey % 4) + 1] AS release_stage,
         CASE o_orderkey % 17 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' ELSE 'a/b.csv' END AS source_file,
         strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') || CASE o_orderkey % 19 WHEN 0 THEN ' 14:00' ELSE 'T14:00:00Z' END AS retrieved_at
  FROM orders
)
SELECT k AS o_orderkey, array_to_string(list_filter([
  CASE WHEN trim(value_text) = '' THEN 'missing_value' END,
  CASE WHEN series_id = 'NOPE' THEN 'unknown_series' END,
  CASE WHEN source_file <> 'a/b.csv' THEN 'unsafe_source_file' END,
  CASE WHEN release_stage = 'guess' THEN 'unknown_stage' END,
  CASE WHEN series_id <> 'NOPE' AND release_stage = 'revision' THEN 'stage_not_allowed' END,
  CASE WHEN observation_date = '2020-1-5' THEN 'invalid_observation_date' END,
  CASE WHEN NOT retrieved_at LIKE '%Z' THEN 'invalid_retrieved_at' END,
  CASE WHEN observation_date <> '2020-1-5' AND release_date < observation_date THEN 'release_before_observation' END,
  CASE WHEN retrieved_at LIKE '%Z' AND release_date > retrieved_at[1:10] THEN 'release_after_retrieval' END], lambda x: x IS NOT NULL), ',') AS codes
FROM t"""
)
def archive_rules_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda shift: F.date_format(F.date_add(F.to_date("o_orderdate"), shift), "yyyy-MM-dd")
    key = F.col("o_orderkey")
    stages = F.array(*[F.lit(x) for x in ("preliminary", "final", "revision", "guess")])
    rows = fx.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, "NOPE").otherwise("UMICH_SCA_T2N_TOP").alias("series_id"),
        F.when(key % 11 == 0, "2020-1-5").otherwise(day(F.lit(0))).alias("observation_date"),
        F.when(key % 13 == 0, " ").otherwise(F.col("o_totalprice").cast("string")).alias("value_text"),
        day((key % 5 - 1).cast("int")).alias("release_date"),
        F.get(stages, (F.col("o_custkey") % 4).cast("int")).alias("release_stage"),
        F.when(key % 17 == 0, "/abs").when(key % 17 == 1, "a/../b").otherwise("a/b.csv").alias("source_file"),
        F.concat(day(F.lit(2)), F.when(key % 19 == 0, " 14:00").otherwise("T14:00:00Z")).alias("retrieved_at"),
        F.lit(False).alias("too_long"),
    )
    return archive.rule_codes(rows).select("o_orderkey", F.array_join("codes", ",").alias("codes"))


# --- the whole composite ---------------------------------------------------------------------------------------------


def _released(spans: DataFrame) -> DataFrame:
    """One row: the first and the last day on which anything was released."""
    return spans.agg(F.min("realtime_start").alias("low"), F.max("realtime_start").alias("high"))


def _months(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """Months that are finalised while the series run."""
    found = calendar.finalizations(spark).crossJoin(F.broadcast(_released(spans)))  # one row
    return found.where(F.col("finalized_on").between(F.col("low"), F.col("high"))).drop("low", "high")


def _final_dates(spark: SparkSession, spans: DataFrame) -> DataFrame:
    return _months(spark, spans).select(F.col("finalized_on").alias("assembly_date"))


def _every_date(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """All weekly assemblies while the series run."""
    found = calendar.assemblies(spark).select("assembly_date").distinct().crossJoin(F.broadcast(_released(spans)))  # one row
    return found.where(F.col("assembly_date").between(F.col("low"), F.col("high"))).select("assembly_date")


#: What the guarded queries are covered for: one series ends early, another has no coverage.
_COVERED = {
    "RSFSDP": "2030-12-31", "RSFHFS": "2030-12-31", "VISASMIDSA": "2019-06-28", "WRMFNS": "2030-12-31",
    "UMICH_SCA_T2N_TOP": "2030-12-31", "REVOLSL": "2030-12-31", "DRCCLACBS": "2030-12-31",
}
_MEMBERS = ", ".join(f"({s.ord}, '{s.series_id}', '{s.family}', {s.staleness_days})" for s in REGISTRY if s.role != "outcome")
_UNITS = (
    "(1, 'census_retail', 'census_retail', 'A'), (3, 'VISASMIDSA', 'visa_smi', 'B'), (4, 'household_liquidity', 'household_liquidity', 'A'), "
    "(6, 'UMICH_SCA_T2N_TOP', 'umich_top_tercile', 'A'), (7, 'REVOLSL', 'strain', NULL), (8, 'DRCCLACBS', 'strain', NULL)"
)


def _composite(asked: str, guarded: bool = False) -> str:
    """WITH ... : the composite at the final dates or at all dates, up to the CTEs scored, families and tiers."""
    covered = ", ".join(f"('{s}', DATE '{d}')" for s, d in _COVERED.items()) if guarded else ", ".join(f"('{s.series_id}', DATE '9999-12-31')" for s in REGISTRY)
    # At an assembly that finalises a month, first prints of the archived series don't count.
    early = "AND NOT (s = 'UMICH_SCA_T2N_TOP' AND early AND assembly_date IN (SELECT finalized_on FROM finals))" if guarded else ""
    assumed = "coalesce(bool_or(s = 'UMICH_SCA_T2N_TOP' AND final), false)" if guarded else "false"
    return (
        OPEN_DAYS
        + """, x AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'RSFSDP' WHEN o_orderpriority = '1-URGENT' THEN 'RSFHFS'
              WHEN o_orderpriority = '2-HIGH' THEN 'VISASMIDSA' WHEN o_orderpriority = '3-MEDIUM' THEN 'UMICH_SCA_T2N_TOP'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'REVOLSL' ELSE 'DRCCLACBS' END AS s,
         o_orderdate + INTERVAL 240 MONTH AS d, o_totalprice::DECIMAL(18,2) AS p
  FROM orders
), sums AS (
  SELECT s, (CASE WHEN s = 'DRCCLACBS' THEN date_trunc('quarter', d) ELSE date_trunc('month', d) END)::DATE AS obs,
         sum(p) FILTER (day(d) <= 15) AS early, sum(p) AS total
  FROM x GROUP BY 1, 2
), known AS (
  SELECT *, (obs + CASE WHEN s = 'DRCCLACBS' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 MONTH END)::DATE + 20 AS k FROM sums
), """
        + fx.SQL["f_weekly"]
        + f""", spans AS (
  SELECT s, obs, k AS rs, k + 27 AS re, early::DOUBLE AS v, true AS early FROM known WHERE early IS NOT NULL
  UNION ALL SELECT s, obs, k + 28, DATE '9999-12-31', total::DOUBLE, false FROM known
  UNION ALL SELECT CASE series WHEN 'A' THEN 'DPSACBW027SBOG' ELSE 'WRMFNS' END, wed - CASE series WHEN 'A' THEN 0 ELSE 2 END, wed + 9,
                   DATE '9999-12-31', value, false FROM f_weekly
), finals AS (
  SELECT month_idx, min(assembly_date) AS finalized_on
  FROM (SELECT *, (year(assembly_date) * 12 + month(assembly_date) - 3)::INT AS month_idx FROM rolled WHERE day(assembly_date) >= 15) GROUP BY 1
), asked AS (
  SELECT DISTINCT assembly_date FROM ({asked}) JOIN (SELECT min(rs) AS low, max(rs) AS high FROM spans) ON assembly_date BETWEEN low AND high
), covered AS (SELECT * FROM (VALUES {covered}) c(s, through)
), pit AS (
  SELECT assembly_date, s, obs, v, rs, early FROM spans JOIN asked ON assembly_date BETWEEN rs AND re JOIN covered USING (s)
  WHERE assembly_date <= through {early}
), w AS (
  SELECT assembly_date, s, date_trunc('month', day)::DATE AS m, avg(v) AS v, count(DISTINCT day) AS n
  FROM (SELECT *, obs + CASE s WHEN 'WRMFNS' THEN 2 ELSE 0 END AS day FROM pit WHERE s IN ('DPSACBW027SBOG', 'WRMFNS')) GROUP BY 1, 2, 3
), wednesdays AS (
  SELECT date_trunc('month', day)::DATE AS m, count(*) AS n FROM days WHERE isodow(day) = 3 GROUP BY 1
), grid AS (
  SELECT assembly_date, s, (year(m) * 12 + month(m) - 1)::INT AS month_idx, v FROM w JOIN wednesdays USING (m, n)
  UNION ALL SELECT assembly_date, s, (year(obs) * 12 + month(obs) - 1)::INT, v FROM pit WHERE s NOT IN ('DPSACBW027SBOG', 'WRMFNS')
), prior AS (
  SELECT *, first_value(v) OVER (PARTITION BY assembly_date, s ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS p FROM grid
), units AS (
  SELECT assembly_date, CASE WHEN s LIKE 'RSF%' THEN 'census_retail' ELSE 'household_liquidity' END AS unit, 36 AS least, month_idx, -(sum(v) - sum(p)) / sum(p) AS v
  FROM prior WHERE s IN ('RSFSDP', 'RSFHFS', 'DPSACBW027SBOG', 'WRMFNS') GROUP BY 1, 2, 3, 4 HAVING count(p) = 2
  UNION ALL SELECT assembly_date, s, 36, month_idx, -(v - p) / p FROM prior WHERE s = 'REVOLSL' AND p IS NOT NULL
  UNION ALL SELECT assembly_date, s, CASE s WHEN 'DRCCLACBS' THEN 20 ELSE 36 END, month_idx,
                   CASE s WHEN 'VISASMIDSA' THEN 100.0 - v WHEN 'UMICH_SCA_T2N_TOP' THEN -v ELSE v END
            FROM grid WHERE s IN ('VISASMIDSA', 'UMICH_SCA_T2N_TOP', 'DRCCLACBS')
), last AS (SELECT assembly_date, unit, max(month_idx) AS now FROM units GROUP BY 1, 2
), refs AS (
  SELECT assembly_date, unit, now, max(least) AS least, count(v) FILTER (old) AS n_refs, avg(v) FILTER (old) AS mean,
         stddev_pop(v) FILTER (old) AS sigma, max(v) FILTER (month_idx = now) AS v
  FROM (SELECT *, month_idx < now AND month_idx >= now - 120 AS old FROM units JOIN last USING (assembly_date, unit)) GROUP BY 1, 2, 3
), scored AS (
  SELECT assembly_date, unit, now AS month_idx, n_refs, v,
         CASE WHEN n_refs >= least AND sigma > 0 THEN greatest(least((v - mean) / sigma, 3.0), -3.0) END AS z,
         CASE WHEN n_refs < least THEN 'z_abstention:insufficient_history:' || n_refs || '<' || least WHEN sigma <= 0 THEN 'z_abstention:zero_population_sigma' END AS why
  FROM refs
), state AS (
  SELECT assembly_date, family, ord, s, newest, final, CASE WHEN through IS NULL OR assembly_date > through THEN 'invalid_member:' || s WHEN newest IS NULL THEN 'missing_member:' || s
         WHEN assembly_date - newest > stale THEN 'stale_member:' || s END AS flag
  FROM asked CROSS JOIN (VALUES {_MEMBERS}) m(ord, s, family, stale) LEFT JOIN covered USING (s)
  LEFT JOIN (SELECT assembly_date, s, max(rs) AS newest, bool_or(NOT early) AS final FROM pit GROUP BY 1, 2) USING (assembly_date, s)
), gated AS (
  SELECT assembly_date, family, string_agg(flag, ',' ORDER BY ord) AS gate, {assumed} AS assumed,
         '{{' || coalesce(string_agg('"' || s || '":"' || newest || '"', ',' ORDER BY s) FILTER (newest IS NOT NULL), '') || '}}' AS releases
  FROM state GROUP BY 1, 2
), joined AS (
  SELECT a.assembly_date, ord, family, u.unit, tier, z, v, month_idx,
         CASE WHEN z IS NULL THEN coalesce(why, 'z_abstention:no_transformed_observations') END AS why
  FROM asked a CROSS JOIN (VALUES {_UNITS}) u(ord, unit, family, tier) LEFT JOIN scored USING (assembly_date, unit)
), summed AS (
  SELECT assembly_date, family, max(tier) AS tier, avg(z) AS mean_z, count(z) = count(*) AS whole, count(*) AS n_units, max(month_idx) AS month_idx, max(v) AS v,
         string_agg(CASE WHEN family = 'strain' THEN regexp_replace(why, '^(z_abstention|invalid_transform)', '\\1:' || unit) ELSE why END, ',' ORDER BY ord) AS reasons
  FROM joined GROUP BY 1, 2
), families AS (
  SELECT assembly_date, family, tier, CASE WHEN gate IS NULL AND whole THEN mean_z END AS z, NOT (gate IS NULL AND whole) AS abstained,
         coalesce(gate, reasons, '') AS flags, CASE WHEN gate IS NULL AND whole AND n_units = 1 THEN v END AS transformed_value,
         CASE WHEN gate IS NULL AND whole THEN month_idx END AS month_idx, releases, assumed
  FROM gated JOIN summed USING (assembly_date, family)
), g AS (
  SELECT assembly_date, avg(z) FILTER (family <> 'visa_smi') AS a, avg(z) AS every, coalesce(bool_or(z IS NOT NULL) FILTER (family = 'visa_smi'), false) AS has_b,
         4 - count(z) AS n_absent, bool_or(assumed) AS assumed,
         string_agg(family, ',' ORDER BY list_position(['census_retail', 'visa_smi', 'household_liquidity', 'umich_top_tercile'], family)) FILTER (z IS NULL) AS gone
  FROM families WHERE family <> 'strain' GROUP BY 1
), tiers AS (
  SELECT assembly_date, round_even(CASE WHEN n_absent < 2 THEN a END, 6) + 0.0 AS tier_a, round_even(CASE WHEN n_absent < 2 AND has_b THEN every END, 6) + 0.0 AS tier_b,
         round_even(CASE WHEN n_absent < 2 THEN CASE WHEN has_b THEN every ELSE a END END, 6) + 0.0 AS headline,
         CASE WHEN n_absent < 2 THEN CASE WHEN has_b THEN 'B' ELSE 'A' END END AS headline_tier, n_absent >= 2 AS abstained,
         concat_ws(',', CASE WHEN assumed THEN 'validation_assumption:umich_unrevised_final' END,
                   CASE WHEN gone IS NOT NULL THEN 'family_abstention:' || replace(gone, ',', ',family_abstention:') END,
                   CASE WHEN n_absent >= 2 THEN 'leading_abstained:' || n_absent || '_of_4_families' WHEN n_absent > 0 THEN 'leading_renormalized:' || gone END) AS flags,
         assembly_date NOT IN (SELECT finalized_on FROM finals) AS provisional
  FROM g
)"""
    )


_FINAL, _ALL = "SELECT finalized_on AS assembly_date FROM finals", "SELECT assembly_date FROM rolled"


@query(_composite(_FINAL) + " SELECT assembly_date, unit, month_idx, n_refs, round_even(z, 5) AS z FROM scored")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit's score at every finalisation, from vintages to z."""
    spans = composite.demo_spans(spark, sf_dir)
    rows = composite.checked(composite.histories(spans, _final_dates(spark, spans)))
    found = composite.scored(composite.transformed(composite.grid(rows)))
    return found.select("assembly_date", "unit", "month_idx", "n_refs", F.bround("z", 5).alias("z"))


@query(_composite(_ALL) + " SELECT * FROM tiers")
def composite_all_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite at every weekly assembly while the series run."""
    spans = composite.demo_spans(spark, sf_dir)
    found = composite.assemblies(spans, _every_date(spark, spans))
    return found.withColumn("flags", F.array_join("flags", ","))


@query(_composite(_ALL, guarded=True) + " SELECT * FROM tiers")
def composite_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with provenance: coverage fails closed, snapshots are checked, first prints are for provisional weeks only."""
    spans = composite.with_provenance(composite.demo_spans(spark, sf_dir))
    coverage = spark.createDataFrame(list(_COVERED.items()), "series_id string, d string").select("series_id", F.to_date("d").alias("complete_through"))
    found = composite.assemblies(spans, _every_date(spark, spans), coverage=coverage)
    return found.withColumn("flags", F.array_join("flags", ","))


@query(
    _composite(_FINAL)
    + """ SELECT assembly_date, family, tier, round_even(z, 6) + 0.0 AS z, abstained, flags, round_even(transformed_value, 6) + 0.0 AS transformed_value,
       month_idx, releases, assumed FROM families"""
)
def composite_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = composite.demo_spans(spark, sf_dir)
    found = composite.families(spans, _final_dates(spark, spans))
    found = composite.rounded(found, "z", "transformed_value").withColumn("flags", F.array_join("flags", ","))
    return found.withColumn("releases", F.to_json("releases"))


_BANDED = (
    _composite(_FINAL)
    + f""", frozen AS (
  SELECT month_idx, finalized_on, tier_a, tier_b, headline, row_number() OVER w AS position,
         (count(tier_a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS reference_count,
         list_sort(list((round(tier_a * 1000000))::BIGINT) FILTER (tier_a IS NOT NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS refs
  FROM tiers JOIN finals ON assembly_date = finalized_on WINDOW w AS (ORDER BY month_idx)
), cut AS (
  SELECT *, {", ".join(f'''CASE WHEN position >= {_BURN} AND reference_count >= {_BURN - 1} THEN round_even(
           (refs[((len(refs) - 1) * {q} // 100) + 1]::DECIMAL(20,0) * 100
            + (refs[least((len(refs) - 1) * {q} // 100 + 2, len(refs))] - refs[((len(refs) - 1) * {q} // 100) + 1])::DECIMAL(20,0) * ((len(refs) - 1) * {q} % 100)::DECIMAL(3,0)
           )::DECIMAL(24,0) * 0.00000001::DECIMAL(9,8), 6)::DOUBLE END AS p{q}''' for q in (70, 85, 95))}
  FROM frozen
), banded AS (
  SELECT *, CASE WHEN tier_a < p70 THEN 'Normal' WHEN tier_a < p85 THEN 'Watch' WHEN tier_a <= p95 THEN 'Elevated' WHEN tier_a > p95 THEN 'High' END AS raw_band,
         CASE WHEN tier_b < p70 THEN 'Normal' WHEN tier_b < p85 THEN 'Watch' WHEN tier_b <= p95 THEN 'Elevated' WHEN tier_b > p95 THEN 'High' END AS tier_b_mapped_band
  FROM cut
), runs AS (
  SELECT *, sum(CASE WHEN raw_band = lag_band THEN 0 ELSE 1 END) OVER (ORDER BY month_idx) AS run_id
  FROM (SELECT *, lag(raw_band) OVER (ORDER BY month_idx) AS lag_band FROM banded)
), counted AS (
  SELECT *, CASE WHEN raw_band IS NOT NULL THEN row_number() OVER (PARTITION BY run_id ORDER BY month_idx) END AS run FROM runs
), dwelt AS (
  SELECT *, last_value(CASE WHEN run >= 2 THEN raw_band END IGNORE NULLS) OVER (ORDER BY month_idx) AS confirmed_band FROM counted
)
SELECT printf('%04d-%02d', month_idx // 12, month_idx % 12 + 1) AS month, finalized_on, tier_a, tier_b, headline, p70, p85, p95, raw_band,
       CASE WHEN raw_band IS NOT NULL THEN confirmed_band END AS published_band, confirmed_band,
       CASE WHEN raw_band IS NOT NULL AND raw_band IS DISTINCT FROM confirmed_band THEN raw_band END AS candidate_band,
       (CASE WHEN raw_band IS NOT NULL AND raw_band IS DISTINCT FROM confirmed_band THEN run ELSE 0 END)::INT AS candidate_count, tier_b_mapped_band
FROM dwelt"""
)


@query(_BANDED)
def composite_frozen_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = composite.demo_spans(spark, sf_dir)
    months = _months(spark, spans)
    found = composite.frozen(composite.assemblies(spans, _final_dates(spark, spans)), months, burn_in=_BURN)
    return found.select(
        "month", "finalized_on", "tier_a", "tier_b", "headline", "p70", "p85", "p95", "raw_band", "published_band",
        "confirmed_band", "candidate_band", "candidate_count", "tier_b_mapped_band",
    )


#: Faults that are put into every sixth record, and the checks that each must fail.
_FAULTS = {
    0: ("source.composite.headline_tier", "arithmetic.headline_tier"), 1: ("source.flags", "sources.assembly_flags"), 2: ("source_hash",),
    3: ("license_notices",), 4: ("band.candidate_count",),
}


@query(
    _composite(_FINAL)
    + f""" SELECT printf('%04d-%02d', month_idx // 12, month_idx % 12 + 1) AS month, "check" FROM finals JOIN asked ON finalized_on = assembly_date
JOIN (VALUES {", ".join(f"({k}, '{c}')" for k, cs in _FAULTS.items() for c in cs)}) f(k, "check") ON month_idx % 6 = k"""
)
def frozen_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen records with known faults, verified by the second path: exactly these faults are found."""
    spans = composite.demo_spans(spark, sf_dir)
    dates = _final_dates(spark, spans)
    families = composite.families(spans, dates)
    assembled = composite.tiers_of(families)
    records = frozen.records_from(composite.frozen(assembled, _months(spark, spans)), families)
    for r in records:
        kind = calendar.month_index(r["month"]) % 6
        if kind == 0:
            r["composite"]["headline_tier"] = "X"
        elif kind == 1:
            r["assembly_flags"] = [*r["assembly_flags"], "forged"]
        elif kind == 2:
            r["source_assembly_sha256"] = "0" * 64
        elif kind == 3:
            r["license_notices"] = [*r["license_notices"], "forged"]
        elif kind == 4:
            r["band"]["candidate_count"] += 1
    lines = spark.createDataFrame([(canonical_bytes(r).decode(),) for r in records], "value string")
    return checker.verify_sequence(frozen.parsed(lines), spans)[0]
