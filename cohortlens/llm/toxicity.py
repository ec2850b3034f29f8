"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import append_columns, give_back, importable, mix, row_blocks, text_array, words

HASH_BITS = 20
MAX_TRAINING_ROWS = 20_000                    # bound of the labelled sample that is learned from
HELD_OUT = 5                                  # one in so many documents is held out
BIAS = 0


class Ftrl(NamedTuple):
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 6


class Model(NamedTuple):
    """Weights other than zero: ascending feature numbers and their weights, at most
    2^HASH_BITS of them (12 MB), so they can be sent to every task."""

    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS, np.float32)
        out[self.index] = self.weight
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and row of every word, pair of neighbours and pair with one word
    between them. Feature 0 is the bias and stands for no word."""
    h, row = words(texts)
    shift = np.uint64(64 - HASH_BITS)
    parts = [mix(h + np.uint64(1)) >> shift]
    rows = [row]
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            pair = mix(h[:-gap] * np.uint64(salt) + (h[gap:] ^ np.uint64(salt)))
            parts.append((pair >> shift)[same])
            rows.append(row[:-gap][same])
    index = np.concatenate(parts).astype(np.int64)
    return np.where(index == BIAS, 1, index), np.concatenate(rows)


def fit_rows(index_of: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> np.ndarray:
    """Weights after FTRL-proximal passes over the rows in the given order; the rate of each
    coordinate falls with its own squared gradients, and L1 keeps rare or useless ones at 0."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - np.where(i == BIAS, 0, p.l1), 0)
        return -shrunk / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for i, y in zip(index_of, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(1 << HASH_BITS))


def held_out(doc_id) -> F.Column:
    """True for the documents whose crc32(doc_id as text) divides by HELD_OUT (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS, params: Ftrl = Ftrl()) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    The sample is the labelled ids with the smallest hashes: the same rows at every
    run, spread over all of the table; it is the whole of a smaller table. Its ids
    (8 bytes each, so 160 kB) are broadcast to the documents; of the rows of one labelled id,
    the text with the least hash is learned from, taken before the shuffle, so that at most ``max_rows`` texts go on
    however often an id is repeated. The passes over their features, which
    follow one another, run in one task, whose size the bound limits. Null labels and labels of unknown documents are
    not used; a repeated label row counts once, a document with different labels as
    its largest. Without
    any labelled row the model is empty, and every score is one half.
    """
    importable(docs.sparkSession)
    known = (labels.where(labels[doc_id].isNotNull() & labels[label].isNotNull() & ~held_out(labels[doc_id]))
             .groupBy(labels[doc_id].cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
             .orderBy(F.xxhash64("k"), "k").limit(max_rows))
    rows = (docs.select(docs[doc_id].cast("long").alias("k"), docs[text].cast("string").alias("t"))
            .join(F.broadcast(known), "k").groupBy("k").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m"))
            .select("k", "y", "m.t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = text_array(batch.column("t")), []
            for a, b in row_blocks(texts):
                index, row = features(texts[a:b])
                pairs = np.unique(row << HASH_BITS | index)
                cuts = np.searchsorted(pairs, np.arange(b - a + 1) << HASH_BITS)
                own = (pairs & ((1 << HASH_BITS) - 1)).astype(np.int32)
                found += [np.append(own[cuts[i]:cuts[i + 1]], np.int32(BIAS)) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["k", "y", "index"])
        give_back()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "k"])
        w = fit_rows(list(rows["index"]), rows["y"].to_numpy(float), params)
        at = np.flatnonzero(w)
        give_back()
        return pd.DataFrame({"index": [at.astype(np.int64)], "weight": [w[at]]})

    fitted = (rows.select("k", "y", "t").mapInArrow(extract, "k long, y int, index array<int>")
              .withColumn("h", F.xxhash64("k")).withColumn("all", F.lit(1))
              .groupBy("all").applyInPandas(fit, "index array<long>, weight array<double>").first())
    if fitted is None:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32))
    return Model(np.array(fitted["index"], np.int64), np.array(fitted["weight"], np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the probability that a text is toxic, from its words alone.

    Each feature counts once in a text, however often it occurs. Null and empty texts
    have the score of the bias. Repeated rows score alike; other columns pass
    through, and one named ``column`` is replaced. No shuffle; memory is an Arrow batch
    plus the features of one long text.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        dense, texts = weights.value.dense(), text_array(batch.column(text))
        out = []
        for a, b in row_blocks(texts):
            index, row = features(texts[a:b])
            used = dense[index] != 0
            pairs = np.unique(row[used] << HASH_BITS | index[used])
            total = np.bincount(pairs >> HASH_BITS, dense[pairs & ((1 << HASH_BITS) - 1)], b - a)
            out.append(1 / (1 + np.exp(-np.clip(total + float(dense[BIAS]), -35, 35))))
        return [pa.array(np.concatenate(out))]

    if column != text:
        docs = docs.drop(column)
    return append_columns(docs, [T.StructField(column, T.DoubleType())], scored)
