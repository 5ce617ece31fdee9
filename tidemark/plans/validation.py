"""Historical validation: reconstruct all months, score them, compare with baselines and a permutation null."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions.canonical import canonical_bytes, digest
from tidemark.functions.values import month_text, positive
from tidemark.operators import autoregression, baselines, outcomes
from tidemark.operators.baselines import Contract
from tidemark.plans import composite
from tidemark.sources import files, frozen

SCHEMA_VERSION = "tidemark.validation.v2"
MONITOR, PENDING = "coincident_monitor", "validation_pending"
#: What a validation of this kind owes, whatever it finds: episodes are few, and none is out of sample.
DEBTS = ("few_episodes", "no_out_of_sample_episode", "unrevised_archive_assumption")
MOST_EPISODES = 4


class ValidationError(RuntimeError):
    """A gate of the validation isn't met."""


def reconstruct(
    spans: DataFrame, start: str, end: str, burn_in: int = 36, coverage: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weekly assemblies, frozen months, families) from the finalisation of ``start`` to that of ``end``, one plan for all weeks.

    With ``coverage`` it fails closed: weeks that the series aren't covered for abstain.
    """
    spark = spans.sparkSession
    first, last = calendar.monthly_finalization_date(start), calendar.monthly_finalization_date(end)
    weeks = calendar.assemblies(spark).where(F.col("assembly_date").between(first, last)).select("assembly_date").distinct()
    families = composite.families(spans, weeks, coverage=coverage).cache()
    weekly = composite.tiers_of(families)
    low, high = calendar.month_index(start), calendar.month_index(end)
    months = calendar.finalizations(spark).where(F.col("month_idx").between(low, high))
    return weekly, composite.frozen(weekly, months, burn_in=burn_in), families


def points(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Monthly points of a frozen sequence: tier A, published band, family scores, abstention, p70."""
    rows = [
        (
            calendar.month_index(r["month"]), r["composite"]["tier_a_value"], r["band"]["published_band"], r["composite"]["abstained"],
            (r["band"]["thresholds"] or {}).get("p70"), {k: f["z_score"] for k, f in r["families"].items()},
        )
        for r in records
    ]
    return spark.createDataFrame(rows, "month_idx int, tier_a double, band string, abstained boolean, p70 double, families map<string,double>")


def score(points_: DataFrame, gaps: DataFrame, contract: Contract, source: str = "primary") -> DataFrame:
    """Primary signals scored against the lead events of the outcome gaps."""
    rows = outcomes.lead_events(points_.withColumn("signal", positive(F.col("band"), F.col("abstained"))), gaps)
    return outcomes.score_signals(rows.withColumn("source", F.lit(source)), ["source"], contract.turning_window)


def baseline_origins(points_: DataFrame, contract: Contract) -> DataFrame:
    """(model, month_idx, signal, mase, reason) for the naive, scalar and vector baselines at every origin."""
    order = ["census_retail", "household_liquidity", "umich_top_tercile"]
    vector = F.array(*[F.col("families")[f] for f in order])
    rows = points_.withColumns(
        {"panel": F.lit(0), "vector": F.when(~F.exists(vector, lambda x: x.isNull()), vector)}
    )
    scalar = baselines.origins(rows, ["panel"], "tier_a", contract.horizon)
    keys = ["panel", "month_idx"]
    long_enough = F.size("history") >= contract.minimum
    naive = scalar.withColumn("forecast", F.when(long_enough, baselines.seasonal_naive(F.col("history"), contract.horizon, contract.season)))
    naive = naive.select(*keys, "forecast", F.when(F.col("forecast").isNull(), "insufficient_history").alias("reason"))
    scalars = rows.withColumn("scalar", F.when(F.col("tier_a").isNotNull(), F.array("tier_a")))
    ar = autoregression.forecasts(scalars, ["panel"], "scalar", 1, contract.ar_lags, contract.horizon, contract.minimum)
    var = autoregression.forecasts(rows, ["panel"], "vector", len(order), contract.var_lags, contract.horizon, contract.minimum)
    every = None
    for model, found in (("seasonal_naive", naive), ("ar", ar), ("var", var)):
        named = found.withColumn("model", F.lit(model))
        every = named if every is None else every.unionByName(named)
    joined = every.join(scalar.select(*keys, "history", "actual", "actual_reason", "p70"), keys)
    signal = baselines.path_signal(F.col("forecast"), F.col("p70"), contract.dwell)
    error = baselines.mase(F.col("history"), F.col("actual"), F.col("forecast"), contract.season)
    why = F.coalesce("actual_reason", F.when(F.col("forecast").isNull(), "forecast_abstention"), F.when(error.isNull(), "undefined_scale"))
    return joined.select(
        "model", "month_idx",
        F.when(F.col("forecast").isNotNull(), signal).alias("signal"),
        F.when(why.isNull(), error).alias("mase"),
        why.alias("mase_reason"),
        F.coalesce("reason", F.when(F.col("p70").isNull(), "threshold_unavailable")).alias("reason"),
    )


def permutation(points_: DataFrame, gaps: DataFrame, contract: Contract) -> dict:
    """The null of joint block permutations: median lead rate, improvement, whether it is practical, and a p-value."""
    spark = points_.sparkSession
    scored = score(points_, gaps, contract)
    observed = outcomes.summarize(scored, ["source"]).first()
    order = Window.partitionBy().orderBy("month_idx")  # a few hundred months
    rows = scored.withColumn("idx", F.row_number().over(order) - 1).select("idx", "month_idx", "signal", "outcome_event")
    n = rows.count()
    table = baselines.permutation_table(spark, n, contract)
    moved = (
        table.where("target is not null")
        .join(F.broadcast(rows.select(F.col("idx").alias("source"), "signal")), "source")
        .join(F.broadcast(rows.select(F.col("idx").alias("target"), "month_idx", "outcome_event")), "target")
    )
    trials = outcomes.summarize(outcomes.score_signals(moved, ["trial"]), ["trial"])
    rate = observed["lead_rate"] if observed else None
    null = trials.agg(
        F.count("lead_rate").alias("scored"),
        F.median("lead_rate").alias("median"),
        F.count_if(F.col("lead_rate") >= F.lit(rate)).alias("above"),
    ).first()
    gain = None if rate is None or null["median"] is None else rate - null["median"]
    return {
        "abstained_trials": contract.trials - null["scored"],
        "improvement": gain,
        "median_null_lead_rate": null["median"],
        "observed_lead_rate": rate,
        "p_value": None if rate is None or not null["scored"] else (null["above"] + 1) / (null["scored"] + 1),
        "practical": None if gain is None else gain >= contract.rope,
        "scored_trials": null["scored"],
    }


def _summary(row) -> dict:
    return {k: row[k] for k in ("episodes", "hits", "lead_rate", "outcome_abstentions", "points", "scorable", "scored_episodes", "signal_abstentions")}


def gates(
    records: list[dict], gaps: DataFrame, frozen_sha256: str, outcome_vintage: date, checker_label: str, checks: int, approved: bool
) -> list[str]:
    """The gates of a validation that aren't met: approval, hash, vintage, checker, and something to validate."""
    tests = {
        "the contract isn't approved": approved,
        "the hash of the sequence is no SHA-256": bool(re.fullmatch("[0-9a-f]{64}", frozen_sha256)),
        "the outcome vintage is no date": isinstance(outcome_vintage, date),
        f"the sequence is {checker_label}": checker_label == "Verified",
        "nothing has been checked": checks > 0,
        "the sequence has no months": bool(records),
        "the outcome has no quarters": not gaps.isEmpty(),
    }
    return [why for why, fine in tests.items() if not fine]


def artifact(
    spark: SparkSession, records: list[dict], gaps: DataFrame, contract: Contract, frozen_sha256: str, outcome_vintage: date, checker_label: str,
    checks: int | None = None, approved: bool = True,
) -> dict:
    """Everything a validation finds, as one JSON value; only a verified sequence is validated."""
    checks = len(records) if checks is None else checks
    if unmet := gates(records, gaps, frozen_sha256, outcome_vintage, checker_label, checks, approved):
        raise ValidationError(unmet[0])
    points_ = points(spark, records).cache()
    gaps = gaps.cache()
    scored = score(points_, gaps, contract).cache()
    primary = _summary(outcomes.summarize(scored, ["source"]).first())
    origins = baseline_origins(points_, contract).cache()
    signals = outcomes.score_signals(
        outcomes.lead_events(origins.select("model", "month_idx", "signal"), gaps), ["model"], contract.turning_window
    )
    by_model = {r["model"]: _summary(r) for r in outcomes.summarize(signals, ["model"]).collect()}
    errors = {r["model"]: (r["mase"], r["n"]) for r in origins.groupBy("model").agg(F.avg("mase").alias("mase"), F.count("mase").alias("n")).collect()}
    floor = []
    for model in sorted(by_model):
        rate, own = by_model[model]["lead_rate"], primary["lead_rate"]
        beats = None if rate is None or own is None else own > rate
        floor.append({"beats": beats, "lead_rate": rate, "mean_mase": errors[model][0], "model": model, "scored_origins": errors[model][1]})
    null = permutation(points_, gaps, contract)
    table = [
        {"band": r["band"], "events": r["events"], "n": r["n"], "probability": r["probability"]}
        for r in sorted(outcomes.calibration(spark, scored).collect(), key=lambda r: r["ord"])
    ]
    probabilities = [r["probability"] for r in table]
    monotonic = None if None in probabilities else all(b >= a - 1e-9 for a, b in zip(probabilities, probabilities[1:]))
    regimes = [
        {"category": r["category"], "dimension": r["dimension"], "macro_lead_rate": r["macro_lead_rate"], "summary": _summary(r)}
        for r in sorted(outcomes.regime_macro(scored).collect(), key=lambda r: (r["dimension"], r["category"]))
    ]
    failed = null["practical"] is False or any(f["beats"] is False for f in floor)
    status = MONITOR if failed else PENDING
    episodes = primary["episodes"]
    return {
        "baseline_floor": floor,
        "baseline_summaries": by_model,
        "calibration": {"monotonic": monotonic, "rows": table},
        "contract": {k: v for k, v in vars(contract).items()},
        "framing": {"claim_status": "descriptive_only", "leading_claim_allowed": False, "monitor_status": status, "research_label": "research_only"},
        "input_contract": {"outcome_vintage": "latest_common", "signal": "published_band", "target": "tier_a"},
        "monitor_status": status,
        "permutation": null,
        "power": {
            "episodes": episodes, "episodes_within_bound": episodes <= MOST_EPISODES, "most_episodes": MOST_EPISODES,
            "out_of_sample_episode_required": True, "scored_episodes": primary["scored_episodes"],
        },
        "primary_summary": primary,
        "regimes": regimes,
        "schema_version": SCHEMA_VERSION,
        "source": {
            "checker_checks": checks, "checker_label": checker_label, "frozen_sha256": frozen_sha256, "outcome_vintage": outcome_vintage.isoformat(),
        },
        "verification_debt": list(DEBTS),
    }


def run(
    spark: SparkSession, store_path: str, gaps: DataFrame, contract: Contract, outcome_vintage: date, checker_label: str, output: str
) -> dict:
    """Validate a frozen store and write the artifact once; the same inputs give the same bytes."""
    data = files.read_regular(store_path, 1 << 30)
    sequence = frozen.load(store_path)
    if not sequence.ok:
        raise ValidationError(f"the store has issues: {sequence.issues[:3]}")
    found = artifact(spark, sequence.records, gaps, contract, digest(data), outcome_vintage, checker_label)
    blob = canonical_bytes(found)
    files.write_once(output, blob)
    return {"artifact_sha256": digest(blob), "months": len(sequence.records), "monitor_status": found["monitor_status"]}


def reconstruct_store(
    spans: DataFrame, path: str, start: str, end: str, burn_in: int = 36, coverage: DataFrame | None = None, weekly_path: str | None = None
) -> int:
    """Freeze every month of a window into a new store, in order; the number of months.

    All weekly assemblies of the window are computed once; ``weekly_path`` keeps them as Parquet.
    """
    weekly, months, families = reconstruct(spans, start, end, burn_in, coverage)
    if weekly_path:
        weekly.write.parquet(weekly_path)
    months = months.cache()
    records = frozen.records_from(months, families.join(months.select("assembly_date"), "assembly_date", "left_semi"))
    expected = calendar.month_index(end) - calendar.month_index(start) + 1
    if len(records) != expected:
        raise ValidationError(f"{len(records)} of {expected} months")
    files.write_once(path, b"".join(canonical_bytes(r) for r in records))
    found = frozen.load(path)
    if not found.ok:
        raise ValidationError(f"the store has issues: {found.issues[:3]}")
    return len(records)
