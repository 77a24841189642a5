"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.llm.texts import map_texts
from panolith.session import discard, written

#: A-Z in lower case; ASCII white space and punctuation become blanks.
_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))
def features(text: str | None, width: int) -> np.ndarray:
    """Hashed features of the whole text: words, pairs of neighbours, and pairs one or two words apart.

    May repeat. Feature `width` is the bias and always there.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    grams = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            grams.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap) + h[gap:]) * np.uint64(0x165667B19E3779F9))
    return np.append((np.concatenate(grams) >> np.uint64(20)) % np.uint64(width), np.uint64(width)).astype(np.int64)


@dataclass
class ToxicityModel:
    """The weights that L1 left over; at most `width` + 1, so small enough for every task."""

    width: int
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(self.width + 1)
        w[self.index] = self.weight
        return w


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ftrl(rows: list[np.ndarray], marks: list[int], width: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights after `epochs` passes of FTRL-proximal with a rate per coordinate; the bias has no L1."""
    z, n = np.zeros(width + 1), np.zeros(width + 1)

    def weights(i):
        pull = np.where(i == width, 0.0, l1)
        return np.where(np.abs(z[i]) <= pull, 0.0, -(z[i] - np.sign(z[i]) * pull) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y in zip(rows, marks, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(width + 1))


def called_for(parts: list[np.ndarray], width: int, l1: float, epochs: int) -> np.ndarray:
    """Which features are met often enough to get a weight; `parts` are the features of all rows, in any pieces.

    While a feature has no weight, each time it is met moves its sum by a gradient, of at most
    1; below L1 it has none, so one met at most L1 times in all epochs changes nothing.
    """
    times = np.zeros(width + 1, dtype=np.int64)
    for part in parts:
        for s in range(0, len(part), 1 << 20):
            times += np.bincount(part[s : s + (1 << 20)], minlength=width + 1)
    keep = times * epochs > l1
    keep[width] = True
    return keep


def feature_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all features, rows' first places and the end) of a column of int32 bytes, in one copy and no objects."""
    wide = pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view("<i4").copy(), (at - at[0]) // 4


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    train_rows: int = 24_000,
    train_features: int = 1 << 26,
    width: int = 1 << 20,
    alpha: float = 4.0,
    beta: float = 1.0,
    l1: float = 10.0,
    l2: float = 0.01,
    epochs: int = 9,
) -> ToxicityModel:
    """A model fitted on at most `train_rows` labelled documents outside the held-out fifth.

    The sample is bounded on purpose: the labelled ids of least hash, so the same ones in every
    run, and of them as many as have `train_features` features together. All text of a
    sampled document counts. Features are hashed where the texts are; one task gets numbers
    only (at most 4 train_features bytes) and fits the weights. The rates, epochs and the
    strong L1, which keeps a feature only if several documents call for it, were chosen on a fifth of
    the training rows. Null labels, ids and texts give no example; an id labelled more than
    once counts with its largest label, and one with several texts with the least of them. Only text
    reaches the features. Without examples every score is near 0.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(F.col(label)).cast("int").alias("__y"))
    )
    total = marked.count()
    least = marked.select("__id", "__y", F.xxhash64(F.lit(11), "__id").alias("__h"))
    if total > train_rows:
        # All below the hash that leaves a few more, so that only about those are sorted.
        share = min(1.0, (train_rows + 8 * train_rows**0.5) / total)
        few = least.where(F.col("__h") <= int(-(2**63) + share * 2**64) - 1)
        least = (few if few.count() >= train_rows else least).orderBy("__h", "__id").limit(train_rows)
    least = written(least, "toxicity_sample")
    sample = (
        docs.where(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
        .join(F.broadcast(least), "__id")  # at most train_rows ids
        .groupBy("__h", "__id", "__y")
        .agg(F.min("__text").alias("__text"))
        .select("__h", "__y", "__text")
    )

    def make():
        return lambda texts: [[np.unique(features(t, width)).astype("<i4").tobytes() for t in texts]]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, marks, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values, edge = feature_lists(batch.column(1))
            whole = int(np.searchsorted(edge, train_features - n, side="right")) - 1
            if whole > 0:
                parts.append((values[: edge[whole]], edge[: whole + 1]))
                marks += [y > 0 for y in batch.column(0).slice(0, whole).to_pylist()]
            n += len(values)
            if n >= train_features:
                break
        keep = called_for([v for v, _ in parts], width, l1, epochs)
        rows: list[np.ndarray] = []
        while parts:
            values, edge = parts.pop(0)
            mask = keep[values]
            sizes = np.add.reduceat(mask, edge[:-1], dtype=np.int64)  # no row is without the bias
            rows += np.split(values[mask], np.cumsum(sizes)[:-1])
        w = ftrl(rows, marks, width, alpha, beta, l1, l2, epochs)
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w[i], pa.float64())], names=["i", "w"])

    hashed = written(map_texts(sample, "__text", "__features binary", make), "toxicity_features")
    one = hashed.repartition(1).sortWithinPartitions("__h", "__features").select("__y", "__features")
    got = one.mapInArrow(fit, "i long, w double").collect() if total else []
    discard(hashed)
    discard(least)
    if not total or not got:
        got = [(width, -20.0)]
    return ToxicityModel(width, np.array([r[0] for r in got]), np.array([r[1] for r in got]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on), by the whole text.

    Each feature counts once however often it stands in a text. Null and empty texts get the
    score of the bias alone. Input columns of these two names are replaced; repeated rows are
    scored alike, and an empty table gives an empty result.
    """
    width, dense = model.width, model

    def make():
        w = dense.dense()
        used = w != 0

        def run(texts: list) -> list[list]:
            scores = []
            for t in texts:
                i = features(t, width)
                scores.append(1 / (1 + np.exp(-np.clip(w[np.unique(i[used[i]])].sum(), -35, 35))))
            return [[float(s) for s in scores], [int(s >= 0.5) for s in scores]]

        return run

    keep = docs.drop("score", "predicted").withColumn("__text", F.col(text))
    return map_texts(keep, "__text", "score double, predicted int", make)
