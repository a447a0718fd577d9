"""What several training-data operators share: checkpoints, slices of Arrow batches, vectorised words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a Python operator takes up at a time.
SLICE_BYTES = 2 << 20
#: Added while hashing; any odd number serves.
BASE = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed by XXH3, the others eight bytes at a time.
LONG = 64
#: Only bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: what is above it isn't computed again, even if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unlike(key: str, *results: str) -> None:
    """Refuses a key column that is named like a column of the result."""
    if key.lower() in results:
        raise ValueError(f"the key can't be named {key}, as a column of the result is")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def remainders(ids: list, n: int) -> list[int | None]:
    return [None if i is None else zlib.crc32(str(i).encode()) % n for i in ids]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches with about `most` bytes of text at most, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes with a line feed after each, and where each text ends; null is empty."""
    raw = [b"" if t is None else t.encode() for t in texts.to_pylist()]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return data, ends


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number; beyond the end there are zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: For the first n bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Each step is a bijection of the eight bytes it takes in, so runs of one length up to eight never collide."""
    size, eight = stops - starts, eights(data)
    out = mixed((size.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mixed(out[at] ^ (eight[starts[at] + k] & FIRST[np.minimum(size[at] - k, 8)]))
    far = np.flatnonzero(size > LONG)
    if len(far):
        raw = data.tobytes()
        out[far] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[far].tolist(), stops[far].tolist())]
    return out


def equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which runs of a (from `at` on) and of b (from `begin` on), of the same size, have the same bytes. a and b: bytes, not eights of them."""
    x, y = eights(a), eights(b)
    out, left = np.ones(len(size), bool), np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        out[left] &= (x[at[left] + k] ^ y[begin[left] + k]) & FIRST[np.minimum(size[left] - k, 8)] == 0
    for i in np.flatnonzero(size > LONG):
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[begin[i] : begin[i] + size[i]])
    return out


class Words:
    """All words of some texts, case of A-Z folded: where they start and end in the bytes, whose they are, a 64-bit hash of each.

    split: 256 booleans, true for bytes that separate words. kinds: gives the kind of each byte; words also end between
    bytes of two kinds above 0."""

    def __init__(self, texts: pa.Array, split: np.ndarray = WHITE, kinds: Callable[[np.ndarray], np.ndarray] | None = None):
        self.raw, self.ends = joined(texts)
        self.data = FOLD[self.raw]
        inside = ~split[self.data]
        if not len(inside) or inside[-1]:
            inside = np.append(inside, False)
        if kinds is None:
            edge = np.diff(inside.view(np.int8), prepend=0)
            self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        else:
            kind = np.where(inside[: len(self.data)], kinds(self.data), 0)
            broken = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            begins = inside & ~np.concatenate(([False], inside[:-1]))
            ends = ~inside & np.concatenate(([False], inside[:-1]))
            begins[1 : len(kind)] |= broken
            ends[1 : len(kind)] |= broken
            self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends)
        self.doc = np.searchsorted(self.ends, self.starts, "right")
        self.n_docs = len(self.ends)
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.hash = hashed(self.data, self.starts, self.stops)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n words from each word on, and whether these are all in one text."""
    size = len(w.hash)
    if size < n:
        return np.zeros(size, np.uint64), np.zeros(size, bool)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[: size - n + 1] = mixed(out[: size - n + 1] + w.hash[i : size - n + 1 + i] + np.uint64(BASE))
    inside = np.zeros(size, bool)
    inside[: size - n + 1] = w.doc[: size - n + 1] == w.doc[n - 1 :]
    return out, inside


def pairs_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(0x2545F4914F6CDD1D))


#: Bits of a map for each hash in it, up to 2^27 (16 MB). A task sends slices of 2^13 of them.
BITS_EACH, MOST_BITS, SLICE = 16, 27, 13


def bit_map(hashes: DataFrame) -> tuple[np.ndarray, int] | None:
    """A map with a bit for each of the hashes (h long), packed, and the logarithm of its bits: a hash has the bit that its highest bits number.

    None if there are no hashes. The map has 2^MOST_BITS bits at most, whatever the number of hashes, and reaches the
    driver slice by slice. It is for leaving work out: what isn't among the hashes may have its bit, never the other way."""
    size = hashes.count()
    if not size:
        return None
    log = min(MOST_BITS, max(SLICE, (BITS_EACH * size - 1).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spots = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - log))
            own = (spots >> np.uint64(SLICE)).astype(np.int64)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            bits = np.zeros((len(first), 1 << SLICE), bool)
            bits[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own)))), spots & np.uint64((1 << SLICE) - 1)] = True
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array([b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")], pa.binary())], ["slice", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(b.as_buffer(), np.uint8)
                held[s] = held[s] | own if s in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["slice", "bits"])

    kind = "slice long, bits binary"
    bits = np.zeros(1 << (log - 3), np.uint8)
    grouped = hashes.repartitionByRange("h").mapInArrow(marks, kind)
    for r in grouped.repartition("slice").mapInArrow(either, kind).toLocalIterator():
        low = r["slice"] << (SLICE - 3)
        bits[low : low + (1 << (SLICE - 3))] |= np.frombuffer(r["bits"], np.uint8)
    return bits, log
