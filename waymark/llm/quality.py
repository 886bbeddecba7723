"""Quality classifier: naive Bayes features under a linear support vector machine.

A text is the set of its byte n-grams, hashed to `HASHED` slots, and of marks of its shape: how
much of it are repeated words, word pairs and lines, capitals and signs, and its length. Each indicator is scaled by
the log ratio of its share among texts of either class, the scaled vectors have length one,
and a hinge loss is minimised by dual coordinate descent. A logistic curve over margins of
texts kept out of that turns a margin into a score.

The model is fitted on at most `sample` labelled rows of each class, those least by a hash
of their id; it is one array of `SLOTS` numbers. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import held_out, small_batches, table
from waymark.llm.tokens import text_list

HASHED = 1 << 16
# Shares from which a mark of shape is set, for each of five shares; then powers of two words.
STEPS = np.array([0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85])
SHAPES, SIZES = 5, 12
SLOTS = HASHED + SHAPES * len(STEPS) + SIZES
SAMPLE = 3000
THRESHOLD = 0.7
EPOCHS = 12
COST = 1.0
# What a low-quality text on the wrong side costs against a good one.
LOST = 1.0
# Every CALIBRATED-th sampled text only sets the curve from margin to score.
CALIBRATED = 4
# Bytes of a text hashed at a time.
_PIECE = 1 << 20


_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_SIGNS = (_BYTES > 32) & (_BYTES < 127) & ~np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)])


def _shares(text: str, raw: np.ndarray) -> tuple[list[float], int]:
    """Repeated words next to each other, repeated pairs, repeated lines, capitals, signs; words."""
    words = text.split()
    lines = text.split("\n")
    if not words:
        return [0.0] * SHAPES, 0
    pairs = max(1, len(words) - 1)
    counts = np.bincount(raw, minlength=256)
    return [
        sum(map(eq, words, islice(words, 1, None))) / pairs,
        1 - len(set(zip(words, islice(words, 1, None)))) / pairs if len(words) > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        float(counts[_UPPER].sum()) / len(raw),
        float(counts[_SIGNS].sum()) / len(raw),
    ], len(words)


def ngram_slots(text: str, seen: np.ndarray) -> np.ndarray:
    """The slots of a text's byte bigrams and trigrams, and of its shape; `seen` is all clear."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    for at in range(0, len(raw), _PIECE):
        part = raw[at : at + _PIECE + 2].astype(np.uint32)
        two = part[:-1] << 8 | part[1:]
        # A bigram is its own slot; a trigram shares the slots by an odd multiplier.
        seen[two] = True
        three = (two[:-1] << 8 | part[2:]) * np.uint32(0x9E3779B1)
        seen[three >> 16] = True
    shares, size = _shares(text, raw)
    for k, share in enumerate(shares):
        at = HASHED + k * len(STEPS)
        seen[at : at + int(np.searchsorted(STEPS, share, side="right"))] = True
    seen[SLOTS - SIZES + min(size.bit_length(), SIZES - 1)] = True
    slots = np.flatnonzero(seen)
    seen[slots] = False
    return slots


@dataclass
class Model:
    """`weight` is the machine's weight times the log ratio; `square` the ratio squared."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[slots].sum())) or 1.0
        return float(self.weight[slots].sum()) / norm + self.bias

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30))))


def fit(slots: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on texts' slots and 0/1 labels. With one class alone the score is that class."""
    zero = np.zeros(SLOTS)
    if len(labels) == 0 or labels.min() == labels.max():
        shift = 0.0 if len(labels) == 0 else 30.0 * (2 * int(labels[0]) - 1)
        return Model(zero, zero, 0.0, 0.0, shift)
    counts = np.ones((2, SLOTS))
    for own, label in zip(slots, labels):
        counts[label, own] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    vectors = []
    for own in slots:
        x = ratio[own]
        vectors.append(x / (np.sqrt((x * x).sum()) or 1.0))
    train = np.flatnonzero(np.arange(len(labels)) % CALIBRATED != 0)
    if len(set(labels[train])) < 2:
        train = np.arange(len(labels))
    sign = 2.0 * labels - 1
    cost = np.where(labels == 1, COST, COST * LOST)
    weight, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(labels))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(train):
            own, x = slots[i], vectors[i]
            slope = sign[i] * (weight[own] @ x + bias) - 1
            new = min(max(alpha[i] - slope / (x @ x + 1), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[own] += step * x
                bias += step
                alpha[i] = new
    rest = np.setdiff1d(np.arange(len(labels)), train)
    rest = rest if len(rest) and len(set(labels[rest])) == 2 else np.arange(len(labels))
    margins = np.array([weight[slots[i]] @ vectors[i] + bias for i in rest])
    slope, shift = _logistic(margins, labels[rest])
    return Model(weight * ratio, ratio * ratio, bias, slope, shift)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a slightly damped logistic curve, by Newton's method."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    damp = np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - damp @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, gradient)
        beta = beta + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return float(beta[0]), float(beta[1])


def sampled_texts(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """`doc_id`, the text and the label of at most `sample` rows of each label, 0 and 1.

    `known` has `doc_id`, once each, and the label. Of texts under one id the least counts.
    """
    _, label = known.columns
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col(label) == q).orderBy(*order).limit(sample) for q in (0, 1)]
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # At most 2 * `sample` ids and labels, hence the broadcast.
    taught = read.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return taught.groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on `docs` (`doc_id`, `text`) whose `labels` (`doc_id`, `quality`) may be learned from.

    Rows of null id or label teach nothing. Only the sampled texts are gathered, as slots.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    known = known.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    taught = sampled_texts(docs, known.groupBy("doc_id").agg(F.min("quality").alias("quality")), sample)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SLOTS, dtype=bool)
        for batch in batches:
            found = [ngram_slots(t, seen).astype("<u4").tobytes() for t in text_list(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "slots": found})

    rows = taught.mapInPandas(slots, "doc_id long, quality int, slots binary")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "slots"]).reset_index(drop=True)
        model = fit([np.frombuffer(s, "<u4").astype(np.int64) for s in rows["slots"]], rows["quality"].to_numpy().astype(int))
        return pd.DataFrame(
            {
                "weight": [model.weight.astype("<f8").tobytes()],
                "square": [model.square.astype("<f8").tobytes()],
                "bias": model.bias,
                "slope": model.slope,
                "shift": model.shift,
            }
        )

    schema = "weight binary, square binary, bias double, slope double, shift double"
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, schema).collect()
    if not fitted:
        return fit([], np.zeros(0, dtype=int))
    (m,) = fitted
    return Model(np.frombuffer(m.weight), np.frombuffer(m.square), m.bias, m.slope, m.shift)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """`doc` (the whole row as a struct) and `score` of each row of `docs`, from `text` alone.

    A null or empty text has the score of no n-grams; every row gives one row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.zeros(SLOTS, dtype=bool)
        for texts in batches:
            yield pd.Series([shared.value.score(ngram_slots(t, seen)) for t in text_list(texts)], dtype=float)

    scored = F.pandas_udf(score, "double")
    return docs.select(F.struct("*").alias("doc"), scored(F.col("text").cast("string")).alias("score"))


def accepted(score: Column, threshold: float = THRESHOLD) -> Column:
    return score >= threshold


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc.doc_id",
        held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        accepted(F.col("score")).cast("int").alias("predicted"),
    )
