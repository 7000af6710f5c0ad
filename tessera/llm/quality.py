"""Quality classifier: supervised subword embeddings.

A document's features are its hashed words and their hashed runs of ``GRAMS`` characters.  A run may begin or end with
the space beside a word (white space of any kind counting as a space) but does not go on beyond it.  Each feature owns
a learned vector; the vectors of each kind are averaged over the document, the averages added, and a softmax layer
tells the classes apart.  Vectors and layer are trained by numpy stochastic gradient descent (step sizes by AdaGrad)
on the driver, over at most ``max_rows`` labelled documents, those with the
smallest hashed ids.  That bound is a parameter of the fit alone; every document is scored, and whole.

Only texts are inputs of a score.  A text without words or bytes (null, empty) is scored by the layer's bias alone.
Labelled rows without a text or with a null label are left out of the fit; without any labelled row, or with one
class only, the score is that class's smoothed share for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textnp
from tessera.llm.common import crc_mod, spread

BUCKET_BITS = 16
GRAMS = (2, 3)
BUCKETS = (1 + len(GRAMS)) << BUCKET_BITS


@dataclass(frozen=True)
class Fit:
    """Parameters of training."""

    max_rows: int = 3000
    dims: int = 8
    epochs: int = 6
    rate: float = 0.5
    seed: int = 5


#: Bytes of text looked at together.
SLICE_BYTES = 1 << 20
_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def features(offsets: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(feature, row)`` for every word and character run, by kind; rows in order."""
    n = len(offsets) - 1
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    words, firsts = textnp.hash_words(offsets, data)
    found = [((words & mask).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), np.diff(firsts)))]
    char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(before[offsets]))
    space = (char == 32) | ((char >= 9) & (char <= 13))
    char = np.where(space, np.uint32(32), char)
    for kind, k in enumerate(GRAMS, 1):
        m = len(char) - k + 1
        if m <= 0:
            found.append((np.zeros(0, np.int32), np.zeros(0, np.int32)))
            continue
        whole = row[:m] == row[k - 1 :]
        for j in range(1, k - 1):
            whole &= ~space[j : m + j]
        at = np.flatnonzero(whole)
        code = char[at].astype(np.uint64)
        for j in range(1, k):
            code = code * _PRIME + char[at + j]
        code = (code * _SPREAD) >> np.uint64(64 - BUCKET_BITS)
        found.append((code.astype(np.int32) + np.int32(kind << BUCKET_BITS), row[at]))
    return found


def _weighted(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text's distinct features and their shares of its words or runs."""
    ids, shares = [], []
    for feature, _ in features(offsets, data):
        if len(feature):
            distinct, count = np.unique(feature, return_counts=True)
            ids.append(distinct)
            shares.append(count / len(feature))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(ids), np.concatenate(shares)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], fit: Fit) -> tuple[np.ndarray, float]:
    """From (features, shares, class 0 or 1): every feature's weight in the log odds of class 1, and their bias.

    The network is linear up to the softmax, so vectors times layer fold into one weight for each feature.
    """
    ones = sum(y for _, _, y in rows)
    if ones in (0, len(rows)):
        return np.zeros(BUCKETS), float(np.log((ones + 1) / (len(rows) - ones + 1)))
    rng = np.random.default_rng(fit.seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, fit.dims)) / fit.dims
    layer, bias = rng.normal(0, 0.5, (fit.dims, 2)), np.log(np.array([len(rows) - ones, ones]) / len(rows))
    seen_v, seen_l, seen_b = np.full(BUCKETS, 1e-8), np.full((fit.dims, 2), 1e-4), np.full(2, 1e-2)
    for epoch in range(fit.epochs):
        rate = fit.rate * (1 - epoch / fit.epochs)
        for i in rng.permutation(len(rows)):
            ids, shares, y = rows[i]
            hidden = shares @ vectors[ids]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            grad = np.outer(hidden, p)
            seen_l += grad * grad
            layer -= rate * grad / np.sqrt(seen_l)
            seen_b += p * p
            bias = bias - 0.1 * rate * p / np.sqrt(seen_b)
            step = shares[:, None] * back
            seen_v[ids] += (step * step).mean(axis=1)
            vectors[ids] -= rate * step / np.sqrt(seen_v[ids])[:, None]
    odds = layer[:, 1] - layer[:, 0]
    return vectors @ odds, float(bias[1] - bias[0])


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), label: str = "quality") -> tuple[np.ndarray, float]:
    """Train on the labelled documents outside the held-out fold (crc32 of the id's text modulo 4 is 2)."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64("doc_id", F.lit(fit.seed)), "doc_id")
        .limit(fit.max_rows)
    )
    # max_rows ids bound this broadcast.
    picked = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = textnp.utf8(batch.column(2))
            for i in range(batch.num_rows):
                ids, shares = _weighted(offsets[i : i + 2] - offsets[i], data[offsets[i] : offsets[i + 1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1),
                        batch.column(1).slice(i, 1),
                        pa.array([ids.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([shares.astype(np.float32).tobytes()], pa.binary()),
                    ],
                    names=["id", "y", "ids", "shares"],
                )

    made = picked.select("doc_id", "__y", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = made.mapInArrow(run, "id bigint, y int, ids binary, shares binary").toPandas()
    rows = rows.sort_values(["id", "ids"], kind="stable")
    found = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), int(y)) for i, s, y in zip(rows.ids, rows.shares, rows.y, strict=True)]
    del rows
    model = train(found, fit)
    # The driver goes on without the rows.
    del found
    pa.default_memory_pool().release_unused()
    return model


def scores(
    docs: DataFrame, model: tuple[np.ndarray, float], *keep: str, text: str = "text", score: str = "score"
) -> DataFrame:
    """The columns *keep* of *docs* and *score*, the probability of class 1."""
    spark = docs.sparkSession
    # The model's size is fixed by BUCKETS.
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    out = T.StructType([docs.schema[c] for c in keep]).add(score, T.DoubleType(), False)
    held = [] if text in keep else [F.col(text).cast("string").alias("__text")]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            offsets, data = textnp.utf8(batch.column(at))
            for a, b in textnp.slices(offsets, SLICE_BYTES):
                n = b - a
                logit = np.full(n, bias)
                for feature, row in features(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]):
                    count = np.bincount(row, minlength=n)
                    logit += np.bincount(row, weights[feature], minlength=n) / np.maximum(count, 1)
                p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                columns = [batch.column(i).slice(a, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64())], names=out.names)

    return spread(docs.select(*keep, *held)).mapInArrow(run, out)
