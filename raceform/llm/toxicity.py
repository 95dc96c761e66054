"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labelled examples; all other text is unlabelled, toxic or not. With class
prior p and logistic loss l, the risk of a classifier g is

    p * mean_P[l(g)] + max(0, mean_U[l(-g)] - p * mean_P[l(-g)])

where the second term estimates the risk on clean text; in a step that drives it below zero, its gradient is
reversed. ``MODELS`` classifiers are trained side by side in tasks of their own, each on the confirmed examples and
another share of the unlabelled ones, and their logits are averaged.

A document is the bag of its distinct words, each as a hashed word and hashed word beginnings. Features are scaled by
how much more or less frequent they are in confirmed than in unlabelled documents, and by how sure that is, so few
examples suffice; features without a clear difference are left out.

Scale: training sees a sample of bounded size (``MAX_POSITIVE``, ``MAX_UNLABELLED``: expected rows, drawn by hash),
and the class prior comes from all labels of the training folds. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from raceform.llm.decontaminate import words

FOLDS = 5
MODELS = 4
MAX_POSITIVE = 3000
MAX_UNLABELLED = 16_000
BITS = 18
BEGINNINGS = (3, 4, 5, 6)
STEPS = 200
RATE = 0.05
DECAY = 1e-3
# Standard errors of difference that a feature needs, and those from which it has its full scale.
UNSURE, SURE = 2.0, 5.0
CACHE_WORDS = 1 << 19
SAMPLE_SCALE = 1 << 30


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, and its beginnings with their length."""
    parts = [word, *(word[:n] + bytes([n]) for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(p) >> (32 - BITS) for p in parts]


def examples(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, feature, count) over the distinct words of each text."""
    known: dict[bytes, np.ndarray] = {}
    rows, columns, values = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for number, text in enumerate(texts):
        found = set(words(text))
        for w in found:
            if w not in known:
                known[w] = np.array(features(w), np.int32)
        if found:
            ids, n = np.unique(np.concatenate([known[w] for w in found]), return_counts=True)
            rows.append(np.full(len(ids), number))
            columns.append(ids)
            values.append(n)
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: list[bytes | None], unlabelled: list[bytes | None], prior: float) -> np.ndarray:
    """Weights of the features, and last the intercept."""
    size, n_p, n_u = 1 << BITS, len(positive), len(unlabelled)
    bias = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return np.append(np.zeros(size), bias).astype(np.float32)
    sides = [examples(positive), examples(unlabelled)]
    in_p, in_u = (np.bincount(column, minlength=size) for _, column, _ in sides)
    share_p, share_u = (in_p + 1) / (n_p + 2), (in_u + 1) / (n_u + 2)
    sure = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(share_u * (1 - share_u) * (1 / n_p + 1 / n_u))
    scale = np.abs(np.log(share_p / share_u)) * np.clip((sure - UNSURE) / (SURE - UNSURE), 0, 1)
    used = np.flatnonzero(scale)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    (row_p, column_p, value_p), (row_u, column_u, value_u) = (
        (row[k], place[column[k]], value[k] * scale[column[k]]) for row, column, value in sides for k in [np.flatnonzero(place[column] >= 0)])
    weights, moment = np.zeros(len(used)), np.zeros((2, len(used) + 1))
    for step in range(1, STEPS + 1):
        g_p = bias + np.bincount(row_p, weights[column_p] * value_p, n_p)
        g_u = bias + np.bincount(row_u, weights[column_u] * value_u, n_u)
        clean = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        sign = 1 if clean >= 0 else -1
        # Derivatives of the risk by each logit.
        d_p = prior / n_p * ((_sigmoid(g_p) - 1) * (sign > 0) - sign * _sigmoid(g_p))
        d_u = sign / n_u * _sigmoid(g_u)
        slope = np.bincount(column_p, d_p[row_p] * value_p, len(used)) + np.bincount(column_u, d_u[row_u] * value_u, len(used)) + DECAY * weights
        slope = np.append(slope, d_p.sum() + d_u.sum())
        moment[0] += 0.1 * (slope - moment[0])
        moment[1] += 0.001 * (slope * slope - moment[1])
        move = RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    out = np.zeros(size + 1, np.float32)
    out[used], out[-1] = weights * scale[used], bias
    return out


class Scorer(dict):
    """Summed weight of each word's features, kept while they fit."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = float(self.weights[features(word)].sum())
        return value

    def score(self, text: bytes | None) -> float:
        # Sorted, so that equal texts get equal sums.
        return float(_sigmoid(self.weights[-1] + sum(map(self.__getitem__, sorted(set(words(text)))))))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Averaged weights; None without a confirmed toxic label in the training folds, the prior alone if no document is in them."""
    learn = fold(F.col("doc_id")) != 0
    known = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = min(0.9, n_toxic / n_known)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SCALE))
    some = lambda most, n: place < int(SAMPLE_SCALE * min(1.0, most / max(1, n)))
    texts = docs.where(learn).select("doc_id", F.col("text").cast("binary").alias("text"))
    toxic = F.broadcast(known.where((F.col("toxic") == 1) & some(MAX_POSITIVE, n_toxic)).select("doc_id"))
    positive = texts.join(toxic, "doc_id", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))).alias("model"), F.lit(True).alias("positive"), "doc_id", "text")
    unlabelled = texts.where(some(MAX_UNLABELLED, texts.count())).select(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(MODELS)).cast("int").alias("model"), F.lit(False).alias("positive"), "doc_id", "text")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], na_position="first")
        chosen = rows["positive"].to_numpy(bool)
        texts = rows["text"].to_numpy()
        weights = train(list(texts[chosen]), list(texts[~chosen]), prior)
        return pd.DataFrame({"weights": [weights.tobytes()]})

    models = positive.unionByName(unlabelled).groupBy("model").applyInPandas(one, "weights binary").collect()
    if not models:
        return train([], [], prior)
    return np.mean([np.frombuffer(m["weights"], np.float32) for m in models], axis=0)


def score(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5).

    Labels are (doc_id, toxic); only those of folds other than 0 are read, null labels are unlabelled, and of several for a
    document the toxic one counts. Null and empty texts have no words and get the score of the intercept. Without any
    confirmed toxic example every score is 0; with labels but no document in the training folds every score is the prior. Repeated rows get equal scores, an empty table an empty result. Extra
    columns pass through, the text with ``keep_text`` only; those named like a result are replaced.
    """
    docs = docs.drop("score", "predicted")
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if weights.value is None else Scorer(weights.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            scores = [0.0 if scorer is None else scorer.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    out = docs.mapInArrow(run, StructType([*kept, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
