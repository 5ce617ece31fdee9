"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: look-alike letters and digits that stand for letters become plain letters, one for one, so that
positions stay. Matches must be whole words; those inside an exception phrase are cancelled. The sum of the weights,
normalised by the length, gives the score through a logistic curve. Weights and curve are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh, small_batches

# Letters of other scripts that look like Latin ones, and digits used as letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ⅰ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: English insults that count as seen in a few toxic texts already; labels outweigh them.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown")
#: Phrases in which such a word is no insult.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "pond scum", "soap scum", "clown fish", "circus clown", "class clown",
)

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= dict.fromkeys((9, 10, 11, 12, 13, 0xA0), " ")
_SIGN = re.compile(r"[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutes as plain letters, white space as spaces; length is kept."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower-case forms
        low = "".join(c.lower()[:1] for c in text)
    if "@" in low or "$" in low:
        low = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", low)
    return low.translate(_FOLD)


@dataclass(frozen=True)
class ToxicityModel:
    """Word weights, exception phrases, and the logistic curve: bias, weight of the sum, weight of the density."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            made.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            made.add_word(fold(phrase), (len(phrase), 0.0))
        if len(made):
            made.make_automaton()
        return made


def hits(text: str, automaton: ahocorasick.Automaton) -> float:
    """The summed weight of the whole-word matches that no exception phrase covers."""
    if not len(automaton) or not text:
        return 0.0
    folded, found, spared = fold(text), [], []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if (start and folded[start - 1].isalnum()) or (end + 1 < len(folded) and folded[end + 1].isalnum()):
            continue
        (found if weight else spared).append((start, end, weight))
    if spared:
        # One sweep over both in order of their starts: a phrase that covers a match has started before, and ends last.
        found.sort()
        spared.sort()
        at, reach, left = 0, -1, []
        for f in found:
            while at < len(spared) and spared[at][0] <= f[0]:
                reach = max(reach, spared[at][1])
                at += 1
            if f[1] > reach:
                left.append(f)
        found = left
    return math.fsum(f[2] for f in found)


def features(weight: float, chars: int) -> tuple[float, float]:
    """The logarithms of the summed weight, and of the weight per thousand characters."""
    return math.log1p(weight), math.log1p(1000.0 * weight / max(chars, 200))


def squash(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; both classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return (-3.0, 2.0, 1.0)
    design = np.column_stack([np.ones(len(y)), x])
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (share * (y - p)) - ridge * np.r_[0.0, beta[1:]] / 100
        hess = (design * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design
        beta = beta + np.linalg.solve(hess + np.diag([1e-9, ridge / 100, ridge / 100]), grad)
    return tuple(float(b) for b in beta)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = 4000,
    max_clean: int = 8000,
    least_odds: float = 2.2,
) -> ToxicityModel:
    """Learn a model from labelled documents.

    The bounds are parameters: at most ``max_toxic`` and ``max_clean`` labelled rows (the first by a hash of the id).
    These rows are read once and written to the shared folder; only the lexicon and two numbers a row reach the driver.
    Rows with a null id, label or text are not used; equal texts count once. Without labelled rows the seeds alone make
    the model.

    A word of two letters or more enters the lexicon if the logarithm of its odds, less one standard error, is
    ``least_odds`` or more: some ten toxic texts of 4,000 and no clean one of 8,000 suffice, in whatever language. No
    word that passes is left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(col(labels, id_col).alias("lab_id"), col(labels, label_col).cast("int").alias("lab")).where(
        "lab_id is not null and lab in (0, 1)"
    )
    known = known.groupBy("lab_id").agg(F.max("lab").alias("lab"))
    dealt = F.xxhash64("lab_id"), F.col("lab_id")
    toxic = known.where("lab = 1").orderBy(*dealt).limit(max_toxic)
    clean = known.where("lab = 0").orderBy(*dealt).limit(max_clean)
    sample = docs.select(col(docs, id_col).alias("doc"), col(docs, text_col).alias("body")).where("body is not null")
    sample = cut(sample.join(F.broadcast(toxic.union(clean)), F.col("doc") == F.col("lab_id")).select("lab", "body"))

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(set(_WORD.findall(fold(t)))))

    seen = (
        sample.select("lab", F.xxhash64("body").alias("copy"), words("body").alias("words"))
        .groupBy("lab", "copy")
        .agg(F.first("words").alias("words"))
    )
    totals = {r["lab"]: r["n"] for r in seen.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).collect()}
    seed = F.col("word").isin(*SEEDS)
    # Seeds count as words of three toxic texts, and of none of 200 clean ones.
    seeds = spark.createDataFrame([(w, 3, 0) for w in SEEDS], "word string, bad long, good long")
    counted = seen.select(F.explode("words").alias("word"), F.col("lab").alias("bad"), (1 - F.col("lab")).alias("good"))
    counted = counted.where(F.length("word") >= 2).unionByName(seeds).groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    n_toxic = totals.get(1, 0) + F.when(seed, 3).otherwise(0) + 4.0
    n_clean = totals.get(0, 0) + F.when(seed, 200).otherwise(0) + 4.0
    # One standard error less, so that chance finds weigh less.
    odds = F.log(bad / n_toxic) - F.log(good / n_clean) - F.sqrt(1 / bad + 1 / good)
    lexicon = counted.select("word", odds.alias("odds")).where(F.col("odds") >= least_odds).collect()
    weights = {r["word"]: round(min((r["odds"] - 2.0) / 3.0, 1.0), 6) for r in sorted(lexicon)}
    model = ToxicityModel(weights, EXCEPTIONS, (-3.0, 2.0, 1.0))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("w double, n long")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value.automaton()
        for batch in texts:
            yield pd.DataFrame({"w": [hits(t, automaton) for t in batch], "n": [len(t) for t in batch]})

    rows = sorted(sample.select("lab", measured("body").alias("m")).select("lab", "m.w", "m.n").collect())
    x = np.array([features(r["w"], r["n"]) for r in rows]).reshape(-1, 2)
    return ToxicityModel(weights, EXCEPTIONS, fit_curve(x, np.array([r["lab"] for r in rows])))


def score(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """Add the toxicity, from 0 to 1, of every whole text. Null and empty texts have that of a text without matches.

    Rows are independent: nothing is shuffled, all columns come back, and a clashing ``score_col`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        automaton = model.automaton()
        bias, a, b = model.curve
        for batch in texts:
            out = []
            for text in batch:
                f = features(hits(text or "", automaton), len(text or ""))
                out.append(squash(bias + a * f[0] + b * f[1]))
            yield pd.Series(out, dtype="float64")

    (made,) = fresh(docs, "tox")
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    out = docs.withColumn(made, scored(col(docs, text_col)))
    return out.select(*[col(out, c) for c in keep], F.col(made).alias(score_col))
