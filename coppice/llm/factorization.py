"""A quality classifier by factorisation machine (operator 3).

A text's features are its hashed words, statistics of its structure, and its sizes. Their pairwise interactions have
low rank and are scored in linear time: half of (sum v x)^2 - sum (v x)^2 for each factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, remainders, slices, unlike
from .learning import Adam, fitted, in_parts, sample, sigmoid

BUCKETS = 1 << 14
RANK = 4
#: Statistics of a text's structure and sizes.
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "marks", "other_marks", "lines", "distinct", "adjacent", "pairs", "one_letter", "long", "capitals")
_BYTE = np.arange(256)
UPPER = (_BYTE >= 65) & (_BYTE <= 90)
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
LETTER = UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
USUAL = np.isin(_BYTE, [ord(c) for c in " .,\n"])


def _share(flags: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[ends] - total[np.concatenate(([0], ends[:-1]))]) / size


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: where each one's words begin (and all end), hashed words without repeats and their values, and the statistics."""
    w = Words(texts)
    size = np.maximum(np.diff(np.concatenate(([0], w.ends))) - 1, 1)
    n = np.maximum(w.counts, 1)
    bucket = (w.hash >> np.uint64(50)).astype(np.int64)
    unique, times = np.unique(w.doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    doc = unique // BUCKETS
    begins = np.searchsorted(doc, np.arange(w.n_docs + 1))
    same = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))) if len(w.hash) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pair = (w.hash[1:] * np.uint64(3) + w.hash[:-1]) >> np.uint64(40)
        of = w.doc[1:][w.doc[1:] == w.doc[:-1]]
        pair = pair[w.doc[1:] == w.doc[:-1]]
    kinds = np.bincount((np.unique((of.astype(np.int64) << 24) | pair.astype(np.int64)) >> 24), minlength=w.n_docs)
    n_pairs = np.maximum(np.bincount(of, minlength=w.n_docs), 1)
    per_word = lambda flags: np.bincount(w.doc, weights=flags, minlength=w.n_docs) / n
    length = w.stops - w.starts
    stats = np.column_stack([
        np.log(size), np.log(n), per_word(length), _share(UPPER[w.raw], w.ends, size), _share(DIGIT[w.raw], w.ends, size),
        _share(~(LETTER | DIGIT | USUAL)[w.raw], w.ends, size), _share((USUAL & (_BYTE > 32))[w.raw], w.ends, size), (_share(w.raw == 10, w.ends, size) * size - 1) / n,
        np.diff(begins) / n, per_word(same), kinds / n_pairs, per_word(length == 1), per_word(length > 20), per_word(UPPER[w.raw[w.starts]]),
    ])
    return begins, unique % BUCKETS, np.sqrt(times / n[doc]), stats


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, begins: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of each row as one run of indices and values, the statistics last."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        n, k = len(stats), stats.shape[1]
        start = begins + k * np.arange(n + 1)
        at = np.arange(len(index)) + k * np.repeat(np.arange(n), np.diff(begins))
        out_i, out_v = np.empty(len(index) + n * k, np.int64), np.empty(len(index) + n * k)
        out_i[at], out_v[at] = index, value
        tail = (start[1:, None] - k + np.arange(k)).ravel()
        out_i[tail], out_v[tail] = np.tile(BUCKETS + np.arange(k), n), z.ravel()
        return start, out_i, out_v

    def margin(self, start: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's outputs, and each row's sums v x of the factors."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, start[:-1], axis=0)
        return self.bias + np.add.reduceat(self.linear[index] * value, start[:-1]) + 0.5 * (sums**2 - np.add.reduceat(vx**2, start[:-1], axis=0)).sum(1), sums


def fit(texts: pa.Array, y: np.ndarray, epochs: int = 12, size: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Model | None:
    """A model by the logistic loss; None without rows."""
    if not len(y):
        return None
    begins, index, value, stats = in_parts(features, texts)
    stats = stats.astype(float)
    rng = np.random.default_rng(7)
    m = Model(stats.mean(0), np.maximum(stats.std(0), 1e-6), np.zeros(1), np.zeros(BUCKETS + len(NAMES)), rng.normal(0, 0.02, (BUCKETS + len(NAMES), RANK)))
    start, index, value = m.rows(begins, index, value, stats)
    adam = Adam([m.bias, m.linear, m.factors], rate)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), size):
            rows = order[low : low + size]
            length = start[rows + 1] - start[rows]
            own = np.concatenate(([0], np.cumsum(length)))
            at = np.arange(own[-1]) - np.repeat(own[:-1] - start[rows], length)
            i, v = index[at], value[at]
            z, sums = m.margin(own, i, v)
            g = np.repeat((sigmoid(z) - y[rows]) / len(rows), length)
            linear = np.bincount(i, g * v, len(m.linear)) + decay * m.linear
            pull = (g * v)[:, None] * (np.repeat(sums, length, axis=0) - m.factors[i] * v[:, None])
            factors = np.column_stack([np.bincount(i, pull[:, f], len(m.linear)) for f in range(RANK)]) + decay * m.factors
            adam.step([np.array([(sigmoid(z) - y[rows]).mean()]), linear, factors])
    return m


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 6000, held_out: int = 2, folds: int = 4, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for every row of docs: key, held_out, score, predicted, and the columns named in keep.

    Learns labels.quality from `rows` labelled rows, and learning.MOST_BYTES of their texts, at most, whose crc32(key as text) mod folds is not held_out. Null and
    empty texts are scored like others, by a text without words. A null key is not held out. Where no labelled row can
    be learned from, every score is 1, so that nothing is rejected unlearned. Other columns of docs are not looked at."""
    unlike(key, "held_out", "score", "predicted", "_text", *map(str.lower, keep))
    share = docs.sparkSession.sparkContext.broadcast(fitted(sample(docs, labels, "quality", key, text, rows, folds, held_out), fit))
    names = [key, "held_out", "score", "predicted"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for part in slices(batches, "_text"):
            score = np.ones(part.num_rows)
            if m:
                begins, index, value, stats = features(part.column(1))
                score = sigmoid(m.margin(*m.rows(begins, index, value, stats))[0])
            fold = remainders(part.column(0).to_pylist(), folds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f == held_out for f in fold]), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(part.column(i) for i in range(2, part.num_columns))], [*names, *keep])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(key, F.col(text).alias("_text"), *keep).mapInArrow(work, ", ".join([f"`{key}` {kinds[key]}, held_out boolean, score double, predicted int", *(f"`{k}` {kinds[k]}" for k in keep)]))
