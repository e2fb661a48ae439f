"""Quality classifier: a factorisation machine (operator 8).

A document is a sparse vector of hashed words, binned structure statistics and
metadata (its length). Every pair of features interacts through low-rank
factors; by the sum-of-squares identity the score takes time linear in the
number of features. Labels and the columns lang, source and doc_id are never
inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import kernels
from loomstone.llm.scratch import appended, trimmed

#: Hashed words, bins of a statistic, factors of a feature.
WORDS, BINS, FACTORS = 1 << 15, 16, 8
#: Labelled rows that are fitted: the bound of the sample.
TRAIN_ROWS = 4000
#: From this score on a document is predicted good.
THRESHOLD = 0.3
#: Weight of all words together, against one per statistic.
WORD_WEIGHT = 4.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[48:58] = 4
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 6
_CLASS[128:] = 7
STATISTICS = 14
FEATURES = WORDS + STATISTICS * BINS


@dataclass
class Sparse:
    """Rows of sparse features: row ``i`` has entries ``at[i]:at[i + 1]``."""

    at: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def rows(self, which: np.ndarray) -> Sparse:
        size = np.diff(self.at)[which]
        at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(at[-1]) + np.repeat(self.at[which] - at[:-1], size)
        return Sparse(at, self.index[take], self.value[take])


def features(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Features of texts given as UTF-8 bytes and offsets. The empty text has its statistics alone."""
    n = len(offsets) - 1
    base = int(offsets[0])
    part, at = data[base : int(offsets[-1])], offsets - base
    bytes_ = np.diff(at)
    hashes, word_at = kernels.word_hashes(data, offsets)
    words = np.diff(word_at)
    doc = np.repeat(np.arange(n), words)
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(15)) | (hashes & np.uint64(WORDS - 1)), return_counts=True)
    word_doc, word_index = (key >> np.uint64(15)).astype(np.int64), (key & np.uint64(WORDS - 1)).astype(np.int64)
    distinct = np.bincount(word_doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, word_doc, count)
    kind = _CLASS[part]
    sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)])[at]) for k in range(1, 8)])
    newline = np.diff(np.concatenate([[0], np.cumsum(part == 10)])[at])
    repeated = np.zeros(len(part), bool)
    if len(part) > 1:
        repeated[1:] = (part[1:] == part[:-1]) & (kind[1:] >= 5) & (kind[1:] <= 6)
    doubled = np.diff(np.concatenate([[0], np.cumsum(repeated)])[at])
    solid = np.maximum(bytes_ - sums[0], 1)
    w = np.maximum(words, 1)
    lead = np.ones(len(part), bool)
    lead &= (part & 0xC0) != 0x80
    chars = np.diff(np.concatenate([[0], np.cumsum(lead)])[at])

    def share(x: np.ndarray) -> np.ndarray:
        """A share of 0 to 1 in bins that are finer near 0."""
        return np.ceil(np.sqrt(np.clip(x, 0, 1)) * (BINS - 1))

    binned = np.stack([
        np.log2(chars + 1), np.log2(words + 1), np.log2(newline + 1), np.log2(1 + words / (newline + 1)), np.clip(solid / w, 0, BINS - 1),
        share(sums[1] / solid), share(sums[3] / solid), share(sums[4] / solid), share(sums[5] / solid), share(sums[6] / solid), share(doubled / solid),
        share(distinct / w), share(top / w), share(sums[2] / solid),
    ])
    stat_index = (WORDS + np.arange(STATISTICS)[:, None] * BINS + np.clip(binned, 0, BINS - 1).astype(np.int64)).T
    total = distinct + STATISTICS
    out_at = np.concatenate([[0], np.cumsum(total)])
    index, value = np.empty(out_at[-1], np.int64), np.ones(out_at[-1], np.float32)
    place = np.arange(len(word_index)) + np.repeat(out_at[:-1] - np.concatenate([[0], np.cumsum(distinct)[:-1]]), distinct)
    index[place] = word_index
    value[place] = count * (WORD_WEIGHT / w[word_doc])
    for s in range(STATISTICS):
        index[out_at[:-1] + distinct + s] = stat_index[:, s]
    return Sparse(out_at, index, value)


@dataclass
class Machine:
    """Bias, weights and factors."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def forward(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, sums of factors, and the factors times values."""
        scaled = self.factor[x.index] * x.value[:, None]
        sums = np.add.reduceat(scaled, x.at[:-1], axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), x.at[:-1])
        linear = np.add.reduceat(self.weight[x.index] * x.value, x.at[:-1])
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, scaled

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[0].astype(np.float64), -30, 30)))


def train(x: Sparse, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Logistic loss by Adam on shuffled batches, in a fixed order: equal rows give equal machines."""
    rng = np.random.default_rng(seed)
    n = len(y)
    share = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))
    params = np.concatenate([m.weight[:, None], m.factor], axis=1)
    m1, m2, step = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            which = order[at : at + batch]
            part = x.rows(which)
            m.weight, m.factor = params[:, 0], params[:, 1:]
            z, sums, scaled = m.forward(part)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[which]) / len(which)).astype(np.float32)
            each = np.repeat(g, np.diff(part.at)) * part.value
            inner = np.repeat(sums, np.diff(part.at), axis=0) - scaled
            used, back = np.unique(part.index, return_inverse=True)
            grad = np.zeros((len(used), 1 + FACTORS), np.float32)
            np.add.at(grad, back, np.concatenate([each[:, None], each[:, None] * inner], axis=1))
            grad += decay * params[used]
            m.bias -= rate * float(g.sum())
            step += 1
            m1[used] = 0.9 * m1[used] + 0.1 * grad
            m2[used] = 0.99 * m2[used] + 0.01 * grad * grad
            params[used] -= rate * (m1[used] / (1 - 0.9**step)) / (np.sqrt(m2[used] / (1 - 0.99**step)) + 1e-6)
    m.weight, m.factor = params[:, 0].copy(), params[:, 1:].copy()
    return m


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> Machine:
    """A machine from at most ``rows`` labelled documents for which ``learn`` holds, drawn by the hash of their ids.

    Equal texts with equal labels count once. Null labels and ids do not count; a
    document with several labels counts with each. Without any label every score
    is 0.5 before learning.
    """
    usable = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality")
    drawn = usable.orderBy(F.xxhash64("doc_id"), "quality").limit(rows)
    named = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select(*named, "quality", "text")

    def featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = kernels.utf8(batch.column(3))
            for i, j in kernels.slices(offsets):
                x = features(data, offsets[i : j + 1])
                lists = [pa.ListArray.from_arrays(x.at.astype(np.int32), pa.array(v)) for v in (x.index.astype(np.int32), x.value)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:3], *lists], ["h1", "h2", "quality", "index", "value"])

    # Features come to the driver, not texts: no more than FEATURES of a row, however long its text is.
    drawn_rows = texts.mapInArrow(trimmed(featured), "h1 long, h2 long, quality int, index array<int>, value array<float>").dropDuplicates(["h1", "h2", "quality"])
    got = drawn_rows.toArrow().sort_by([("h1", "ascending"), ("h2", "ascending"), ("quality", "ascending")])
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    sizes = np.diff(index.offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
    x = Sparse(np.concatenate([[0], np.cumsum(sizes)]), index.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value.flatten().to_numpy(zero_copy_only=False).astype(np.float32))
    return train(x, got.column("quality").to_numpy().astype(np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds ``quality_score`` of the whole text, 0 to 1; null counts as empty. All rows stay, and all columns but one of that name; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def make(column: pa.Array):
        data, offsets = kernels.utf8(column)
        for i, j in kernels.slices(offsets):
            yield i, j, [pa.array(shipped.value.score(features(data, offsets[i : j + 1])), pa.float64())]

    return appended(docs, "text", {"quality_score": "double"}, make)
