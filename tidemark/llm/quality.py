"""Text quality by a factorisation machine.

Features are hashed words, structure statistics and metadata (the length) in steps. A factorisation machine gives each
feature a weight and a short vector; every pair of features interacts by the product of its vectors. The sum over all
pairs is half the square of the sum minus the sum of the squares, so a text is scored in time linear in its features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh, small_batches

BUCKETS = 1 << 15
STATS = 24
#: Steps by which a statistic becomes one of so many features.
STEPS = 12
SIZE = BUCKETS + STATS * (STEPS + 1)
_EDGE = re.compile(r"^\W+|\W+$")
#: Hashed words are remembered up to this number; forgetting changes no result.
REMEMBERED = 200_000


def bucket_of(word: str) -> int:
    """The hashed shape of a word: lower-cased without punctuation at its ends, plus what the punctuation was."""
    bare = _EDGE.sub("", word)
    tail = word[len(word) - 1 :] if not bare or not word[-1].isalnum() else ""
    return zlib.crc32(f"{bare.lower()} {tail}".encode()) % BUCKETS


class Words:
    """Remembers the buckets of frequent words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def buckets(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    if len(known) >= REMEMBERED:
                        return [known[w] if w in known else bucket_of(w) for w in words]
                    known[w] = bucket_of(w)
            return [known[w] for w in words]


def statistics(text: str, words: list[str]) -> list[float]:
    """Numbers between 0 and 1 on the structure of a text, and its length in steps."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    counts, line_counts = Counter(words), Counter(lines)
    top = counts.most_common(1)[0][1] if counts else 0
    pairs = Counter(zip(words, words[1:]))
    upper = sum(map(str.isupper, words))
    letters = sum(map(str.isalpha, words))
    marks = {m: text.count(m) for m in ".,!|#$%&*<>{}=/@"}
    odd = sum(marks[m] for m in "|#$%&*<>{}=")
    digits = sum(text.count(d) for d in "0123456789")
    return [
        upper / n,
        letters / n,
        len(counts) / n,
        top / n,
        1 - len(pairs) / max(n - 1, 1),
        sum(c for c in pairs.values() if c > 2) / max(n - 1, 1),
        1 - len(line_counts) / len(lines),
        min(1.0, n / len(lines) / 200),
        min(1.0, (chars - n + 1) / n / 20),
        min(1.0, odd / n),
        min(1.0, marks["!"] / n),
        min(1.0, marks["|"] / n),
        min(1.0, (marks["."] + marks[","]) / n),
        min(1.0, marks["."] / len(lines) / 10),
        digits / chars,
        min(1.0, (marks["/"] + marks["@"]) / n),
        min(1.0, max(map(len, words), default=0) / 60),
        sum(1 for w in counts if len(w) > 24) / max(len(counts), 1),
        sum(1 for x in lines if x[-1:] in ".!?") / len(lines),
        min(1.0, math.log1p(chars) / 14),
        min(1.0, math.log1p(n) / 12),
        min(1.0, math.log1p(len(lines)) / 8),
        sum(1 for w in counts if not w[:1].isalnum()) / max(len(counts), 1),
        sum(map(str.istitle, words)) / n,
    ]


def encode(text: str, memory: Words) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, as ascending indexes with values."""
    words = text.split()
    index, value = np.zeros(0, np.int64), np.zeros(0)
    if words:
        index, count = np.unique(np.asarray(memory.buckets(words), np.int64), return_counts=True)
        value = 1.0 + np.log(count)
        value /= np.sqrt((value**2).sum())
    stats = statistics(text, words)
    steps = [BUCKETS + i * (STEPS + 1) + min(STEPS, int(s * STEPS)) for i, s in enumerate(stats)]
    return np.concatenate([index, np.asarray(steps, np.int64)]), np.concatenate([value, np.full(STATS, 0.5)])


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        """bias + linear part + half of (square of the sum less sum of the squares), over all factors."""
        v = self.factors[index] * value[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.weight[index] @ value + 0.5 * ((s * s).sum() - (v * v).sum()))


def squash(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 6, epochs: int = 8, rate: float = 0.08,
    decay: float = 1e-5, seed: int = 5,
) -> FactorisationMachine:
    """Adaptive gradient descent on the logistic loss; both classes weigh the same, then the bias is set back."""
    rng = np.random.default_rng(seed)
    weight, factors, bias = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)), 0.0
    if not len(labels):
        return FactorisationMachine(0.0, weight, factors * 0)
    share = float(np.clip(labels.mean(), 0.5 / (len(labels) + 1), 1 - 0.5 / (len(labels) + 1)))
    if labels.min() == labels.max():
        return FactorisationMachine(math.log(share / (1 - share)), weight, factors * 0)
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, rank), 1e-2), 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            v = factors[i] * x[:, None]
            s = v.sum(axis=0)
            out = bias + weight[i] @ x + 0.5 * ((s * s).sum() - (v * v).sum())
            pull = (squash(out) - labels[k]) * (0.5 / share if labels[k] else 0.5 / (1 - share))
            dw = pull * x + decay * weight[i]
            dv = pull * x[:, None] * (s - v) + decay * factors[i]
            gw[i] += dw * dw
            gv[i] += dv * dv
            gb += pull * pull
            weight[i] -= rate * dw / np.sqrt(gw[i])
            factors[i] -= 0.5 * rate * dv / np.sqrt(gv[i])
            bias -= rate * pull / math.sqrt(gb)
    return FactorisationMachine(bias, weight, factors)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_good: int = 3000,
    max_bad: int = 3000,
    max_features: int = 8_000_000,
) -> FactorisationMachine:
    """Train on at most ``max_good`` and ``max_bad`` labelled documents, the first by a hash of their id.

    The sample is broadcast as ids with labels. Its rows reach the driver as feature indexes with counts, never as text,
    the first by their hash up to ``max_features`` features in all: that bounds the driver's memory, at 12 bytes each,
    whatever the texts. Rows with a null id, label or text are not used; equal texts count once. Without labels, all
    texts score one half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(col(labels, id_col).alias("lab_id"), col(labels, label_col).cast("int").alias("lab")).where(
        "lab_id is not null and lab in (0, 1)"
    )
    known = known.groupBy("lab_id").agg(F.min("lab").alias("lab"))
    dealt = F.xxhash64("lab_id"), F.col("lab_id")
    good = known.where("lab = 1").orderBy(*dealt).limit(max_good)
    bad = known.where("lab = 0").orderBy(*dealt).limit(max_bad)
    sample = docs.select(col(docs, id_col).alias("doc"), col(docs, text_col).alias("body")).where("body is not null")
    sample = sample.join(F.broadcast(good.union(bad)), F.col("doc") == F.col("lab_id"))

    @F.pandas_udf("i array<int>, x array<float>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Words()
        for batch in texts:
            rows = [encode(t, memory) for t in batch]
            yield pd.DataFrame({"i": [r[0].astype(np.int32) for r in rows], "x": [r[1].astype(np.float32) for r in rows]})

    made = sample.select("doc", "lab", F.xxhash64("body").alias("copy"), encoded("body").alias("f"))
    made = made.groupBy("copy", "lab").agg(F.min("doc").alias("doc"), F.first("f").alias("f"))
    made = cut(made.withColumns({"n": F.size("f.i"), "dealt": F.xxhash64("doc", "copy")}))
    ahead = Window.orderBy("dealt", "copy", "lab")  # some thousand rows
    kept = made.select("copy", "lab", "dealt", F.sum("n").over(ahead).alias("ahead")).where(F.col("ahead") <= max_features)
    rows = made.join(F.broadcast(kept.select("copy", "lab")), ["copy", "lab"]).select("doc", "copy", "lab", "f.i", "f.x").toPandas()
    rows = rows.sort_values(["doc", "copy", "lab"])
    features = [(np.asarray(i, np.int64), np.asarray(x, np.float64)) for i, x in zip(rows["i"], rows["x"])]
    return train(features, rows["lab"].to_numpy(np.float64))


def score(
    docs: DataFrame, model: FactorisationMachine, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """Add the quality, from 0 to 1, of every whole text; null texts count as empty ones.

    Rows are independent: nothing is shuffled, all columns come back, and a clashing ``score_col`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, memory = shared.value, Words()
        for batch in texts:
            yield pd.Series([squash(model.raw(*encode(t or "", memory))) for t in batch], dtype="float64")

    (made,) = fresh(docs, "qual")
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    out = docs.withColumn(made, scored(col(docs, text_col)))
    return out.select(*[col(out, c) for c in keep], F.col(made).alias(score_col))
