"""Vector autoregressions at every origin, from running sums.

The normal equations of a history are sums over its months, so those of the next origin are these and one month more. Two
windows give them to all origins: lags, and running sums of all products. What is left for an origin is one small system of
equations; batches of origins are solved together. No origin carries its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A pivot so small against the largest entry (or 1) counts as zero: smooth data are singular.
PIVOT = 1e-12


def solve(matrices: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Jordan with partial pivoting of many systems at once: (solutions, whether each could be solved)."""
    n, width = len(matrices), matrices.shape[1]
    rows = np.concatenate([matrices, rights], axis=2)
    limit = PIVOT * np.maximum(1.0, np.abs(matrices).max(axis=(1, 2), initial=0.0))
    fine, each = np.ones(n, bool), np.arange(n)
    with np.errstate(all="ignore"):
        for c in range(width):
            best = c + np.argmax(np.abs(rows[:, c:, c]), axis=1)
            pivot = rows[each, best]
            rows[each, best] = rows[:, c]
            fine &= np.abs(pivot[:, c]) > limit
            lead = pivot / pivot[:, c : c + 1]
            rows = rows - rows[:, :, c : c + 1] * lead[:, None, :]
            rows[:, c] = lead
    found = rows[:, :, width:]
    return found, fine & np.isfinite(found).all(axis=(1, 2))


def ahead(coefficients: np.ndarray, state: np.ndarray, horizon: int) -> np.ndarray:
    """Recursive forecasts (origin, step, component); ``state`` has the newest values first, as the equations have them."""
    width, steps = coefficients.shape[2], []
    with np.errstate(all="ignore"):
        for _ in range(horizon):
            design = np.concatenate([np.ones((len(state), 1)), state], axis=1)
            now = np.einsum("nk,nkc->nc", design, coefficients)
            steps.append(now)
            state = np.concatenate([now, state[:, :-width]], axis=1)
    return np.stack(steps, axis=1)


def running_sums(rows: DataFrame, keys: list[str], vector: str, width: int, lags: int) -> DataFrame:
    """keys, month_idx, n (months of the unbroken history), odd, gram, right and state for every month with a vector.

    A month without a vector breaks the history. ``gram`` is the upper triangle of the sums of products of what a month is
    told from (1, then the months before it, the newest first); ``right`` those with its own values. ``odd`` is the reason
    of a history that holds something unusable, for all origins after it.
    """
    order = Window.partitionBy(*keys).orderBy("month_idx")
    rows = rows.select(*keys, "month_idx", F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("island", F.count_if(F.col("v").isNull()).over(order)).where("v is not null")
    past = Window.partitionBy(*keys, "island").orderBy("month_idx")
    so_far = past.rowsBetween(Window.unboundedPreceding, 0)
    wrong = F.when(F.size("v") != width, 2).when(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), 1).otherwise(0)
    before = [F.lag("v", k).over(past) for k in range(1, lags + 1)]
    rows = rows.withColumns({"n": F.row_number().over(past), "wrong": wrong, **{f"lag{k}": lag for k, lag in enumerate(before, 1)}})
    told = F.concat(F.array(F.lit(1.0)), *[F.col(f"lag{k}") for k in range(1, lags + 1)])
    rows = rows.withColumns({"x": F.when(F.col("n") > lags, told), "state": F.concat("v", *[F.col(f"lag{k}") for k in range(1, lags)])})
    size = 1 + lags * width
    entry = lambda name, i: F.get(F.col(name), F.lit(i))
    gram = [F.sum(entry("x", i) * entry("x", j)).over(so_far) for i in range(size) for j in range(i, size)]
    right = [F.sum(entry("x", i) * F.when(F.col("x").isNotNull(), entry("v", c))).over(so_far) for i in range(size) for c in range(width)]
    worst = F.max("wrong").over(so_far)
    odd = F.when(worst == 2, "inconsistent_vector_width").when(worst == 1, "non_finite_history")
    return rows.select(*keys, "month_idx", "n", odd.alias("odd"), F.array(*gram).alias("gram"), F.array(*right).alias("right"), "state")


def forecasts(rows: DataFrame, keys: list[str], vector: str, width: int, lags: int, horizon: int, minimum: int) -> DataFrame:
    """keys, month_idx, forecast (the mean over components, for each step) and reason, for every month.

    ``vector`` is an array column of ``width`` doubles; with one component this is the scalar autoregression. Each equation
    has an intercept and ``lags`` months, and is fitted to the unbroken history that ends with the month. A month has no
    forecast if its history is short, holds values that aren't finite or vectors of another width, or if its equations
    can't be solved.
    """
    size, least = 1 + lags * width, max(minimum, lags * width + 2)
    sums = running_sums(rows, keys, vector, width, lags)
    ready = sums.where(F.col("odd").isNull() & (F.col("n") >= least)).select(*keys, "month_idx", "gram", "right", "state")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*keys, "month_idx").schema.fields)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            grams = np.zeros((len(batch), size, size))
            grams[:, upper[0], upper[1]] = np.stack(batch["gram"].to_numpy())
            grams[:, upper[1], upper[0]] = grams[:, upper[0], upper[1]]
            solved, fine = solve(grams, np.stack(batch["right"].to_numpy()).reshape(len(batch), size, width))
            path = ahead(solved, np.stack(batch["state"].to_numpy()), horizon).mean(axis=2)
            finite = np.isfinite(path).all(axis=1)
            out = batch[[*keys, "month_idx"]].copy()
            out["forecast"] = pd.Series([p if a and b else None for p, a, b in zip(path, fine, finite)], index=out.index, dtype=object)
            out["reason"] = np.where(~fine, "singular_fit", np.where(~finite, "non_finite_forecast", None))
            yield out

    fitted = ready.mapInPandas(run, f"{kinds}, forecast array<double>, reason string")
    short = rows.select(*keys, "month_idx").join(sums.select(*keys, "month_idx", "odd", F.lit(True).alias("known")), [*keys, "month_idx"], "left")
    joined = short.join(fitted, [*keys, "month_idx"], "left")
    why = F.coalesce("odd", "reason", F.when(F.col("forecast").isNull(), "insufficient_history"))
    return joined.select(*keys, "month_idx", "forecast", why.alias("reason"))
