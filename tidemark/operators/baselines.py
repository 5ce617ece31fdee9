"""Baseline forecasts, their errors, and the block-permutation null."""

from __future__ import annotations

import array
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut

@dataclass(frozen=True)
class Contract:
    """The pinned parameters of a validation run."""

    season: int = 12
    ar_lags: int = 12
    var_lags: int = 1
    horizon: int = 6
    minimum: int = 36
    dwell: int = 2
    block: int = 12
    embargo: int = 12
    trials: int = 10_000
    seed: int = 20260719
    turning_window: int = 6
    rope: float = 0.15

    def __post_init__(self) -> None:
        if min(self.season, self.ar_lags, self.var_lags, self.horizon, self.dwell, self.block, self.trials) < 1:
            raise ValueError("lags, season, horizon, dwell, block and trials must be positive")
        if self.minimum < self.season or self.embargo < 0 or self.turning_window < 0:
            raise ValueError("the minimum can't be below the season, nor embargo or window below zero")


def seasonal_naive(history: Column, horizon: int, season: int = 12) -> Column:
    """The last season of an array, repeated; null if the history is shorter."""
    n = F.size(history)
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    return F.when(n >= season, F.transform(steps, lambda k: F.element_at(history, n - season + k % season + 1)))


def mase(training: Column, actual: Column, forecast: Column, season: int = 12) -> Column:
    """Mean absolute error in units of the training data's mean absolute seasonal difference; null if undefined."""
    n = F.size(training)
    later = F.slice(training, F.lit(season + 1), F.greatest(n - season, F.lit(0)))
    earlier = F.slice(training, F.lit(1), F.greatest(n - season, F.lit(0)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    scale = mean(F.zip_with(later, earlier, lambda a, b: F.abs(a - b)))
    error = mean(F.zip_with(actual, forecast, lambda a, b: F.abs(a - b)))
    fits = (n > season) & (F.size(actual) == F.size(forecast)) & (F.size(actual) > 0)
    return F.when(fits, F.when(scale > 0, error / scale))


def path_signal(path: Column, threshold: Column, dwell: int = 2) -> Column:
    """Whether a forecast path stays at or above a threshold for ``dwell`` steps in a row."""
    starts = F.sequence(F.lit(0), F.size(path) - dwell)
    run = F.exists(starts, lambda s: F.forall(F.slice(path, s + 1, F.lit(dwell)), lambda v: v >= threshold))
    return F.when(threshold.isNotNull() & (F.size(path) >= dwell), run)


def origins(rows: DataFrame, keys: list[str], value: str, horizon: int) -> DataFrame:
    """For each month: the unbroken history that ends with it, and the months after it, as arrays.

    A null breaks the history. Short futures and nulls among them have reasons.
    """
    order = Window.partitionBy(*keys).orderBy("month_idx")
    rows = rows.withColumn("island", F.count_if(F.col(value).isNull()).over(order))
    past = Window.partitionBy(*keys, "island").orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(1, horizon)
    rows = rows.withColumns(
        {
            "history": F.when(F.col(value).isNotNull(), F.collect_list(value).over(past)),
            "ahead": F.count(F.lit(1)).over(ahead),
            "actual": F.collect_list(value).over(ahead),
        }
    )
    reason = F.when(F.col("ahead") < horizon, "future_horizon_unavailable").when(
        F.size("actual") < horizon, "future_actual_abstention"
    )
    return rows.withColumn("actual_reason", reason).drop("island", "ahead")


def block_permutation(
    length: int, block: int, embargo: int, rng: random.Random, attempts: int = 20_000
) -> tuple[int, ...]:
    """A circular block permutation that moves every index by more than ``embargo``; empty if none is found."""
    if length <= block or embargo >= length // 2:
        return ()
    for _ in range(attempts):
        turn = rng.randrange(length)
        starts = list(range(0, length, block))
        rng.shuffle(starts)
        at, far = 0, True
        for start in starts:  # all indexes of a block move by the same distance
            moved = (turn + start - at) % length
            far = far and min(moved, length - moved) > embargo
            at += min(block, length - start)
        if far:
            return tuple((turn + i) % length for start in starts for i in range(start, min(start + block, length)))
    return ()


#: Trials between two snapshots of the random stream: what one task replays.
REPLAYED = 250


def _state(stream: random.Random) -> bytes:
    """The generator's 624 words and its place among them, 2,500 bytes."""
    return array.array("I", stream.getstate()[1]).tobytes()


def _restored(state: bytes) -> random.Random:
    stream = random.Random()
    stream.setstate((3, tuple(array.array("I", state)), None))
    return stream


def stream_snapshots(lengths: DataFrame, contract: Contract, every: int = REPLAYED) -> DataFrame:
    """(length, first_trial, state): the random stream of each length before every ``every``-th trial.

    How much a trial draws is only known when it has been drawn, so one task follows the stream of a length. It keeps no
    trial; different lengths have streams of their own, in tasks of their own.
    """

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length in batch["length"].tolist():
                stream, found = random.Random(contract.seed), []
                for trial in range(contract.trials):
                    if trial % every == 0:
                        found.append((length, trial, _state(stream)))
                    block_permutation(length, contract.block, contract.embargo, stream)
                yield pd.DataFrame(found, columns=["length", "first_trial", "state"])

    return lengths.select(F.col("length").cast("int")).distinct().repartition("length").mapInPandas(follow, "length int, first_trial int, state binary")


def permutation_tables(lengths: DataFrame, contract: Contract, every: int = REPLAYED) -> DataFrame:
    """(length, trial, target, source) of every trial for each length of ``lengths``.

    Trials come from one seeded stream a length, so they reproduce exactly. The stream is followed once for its snapshots;
    these are kept by a checkpoint, and tasks replay the trials after each of them. A trial without a permutation has one
    row, with nulls.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, first, state in batch.itertuples(index=False):
                stream, found = _restored(state), []
                for trial in range(first, min(first + every, contract.trials)):
                    found.append((length, trial, list(block_permutation(length, contract.block, contract.embargo, stream))))
                yield pd.DataFrame(found, columns=["length", "trial", "sources"])

    snapshots = cut(stream_snapshots(lengths, contract, every))
    drawn = snapshots.repartition("length", "first_trial").mapInPandas(replay, "length int, trial int, sources array<int>")
    return drawn.select("length", "trial", F.posexplode_outer("sources").alias("target", "source"))


def permutation_table(spark: SparkSession, length: int, contract: Contract) -> DataFrame:
    """(trial, target, source) of every trial over one sequence of ``length`` months."""
    return permutation_tables(spark.createDataFrame([(length,)], "length int"), contract).drop("length")
