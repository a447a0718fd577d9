"""What the two classifiers share: bounded samples of labelled rows, hashed words of texts, Adam steps."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, Words, eights, mixed, remainder, slices

#: Bytes of labelled texts that a model is fitted on at most.
MOST_BYTES = 1 << 26


def sample(docs: DataFrame, labels: DataFrame, target: str, key: str, text: str, rows: int, folds: int | None, held_out: int) -> DataFrame:
    """(key, text, y) of `rows` labelled rows at most: those whose key's hash is smallest.

    Labels that are null count as none; of several for one key, the largest holds. folds: with None, rows of every
    remainder are taken; else those of held_out are left out."""
    own = labels.where(F.col(key).isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.max(target).cast("int").alias("y"))
    if folds:
        own = own.where(remainder(F.col("_k"), folds) != held_out)
    chosen = own.orderBy(F.xxhash64("_k"), "_k").limit(rows)  # its size is bounded by the parameter
    met = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_k")).select(F.col(key).alias("k"), F.col(text).alias("text"), "y")
    return met.orderBy(F.xxhash64("k"), "k", "text").limit(rows)


def fitted(known: DataFrame, fit: Callable[[pa.Array, np.ndarray], object]) -> object:
    """fit(texts, y) of a bounded sample (k, text, y), run in one task so that the driver needs no memory for it.

    Rows are taken in their order until their texts have MOST_BYTES; those that would go beyond it are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            size = pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
            fits = []
            for n in size.tolist():
                fits.append(held + n <= MOST_BYTES)
                held += n if fits[-1] else 0
            kept.append(batch.filter(pa.array(fits, pa.bool_())))
        rows = pa.Table.from_batches(kept, schema=pa.schema([("text", pa.string()), ("y", pa.int32())]))
        model = fit(rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = known.select("text", "y").coalesce(1).mapInArrow(work, "model binary").first()
    return pickle.loads(got[0]) if got else None


def in_parts(features: Callable[[pa.Array], tuple], texts: pa.Array) -> list[np.ndarray]:
    """features of many texts, a slice at a time: where each text's features begin (and all end), then the features in small types."""
    got = [features(part.column(0)) for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))]
    sizes = np.concatenate([np.diff(g[0]) for g in got])
    rest = [np.concatenate([g[i].astype(np.int32 if g[i].dtype.kind == "i" else np.float32) for g in got]) for i in range(1, len(got[0]))]
    return [np.concatenate(([0], np.cumsum(sizes))), *rest]


def prefixes(w: Words, n: int) -> np.ndarray:
    """A hash of the first n bytes (7 at most) of each word, or of all it has; words shorter than n are hashed with their end."""
    size = np.minimum(w.stops - w.starts, n)
    return mixed((eights(w.data)[w.starts] & FIRST[size]) | (size.astype(np.uint64) << np.uint64(56)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps for a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
