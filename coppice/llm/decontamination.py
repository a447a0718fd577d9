"""Benchmark decontamination by SimHash of item-sized windows (operator 8).

Every window of a document that is as long as an item may be a copy of it. Two bags of shingles of a similarity s have
at least s / (1 + s) of all their shingles in common, so blocks of windows with fewer shingles of items of that size are
abandoned at once, which loses none. Every other window, wherever it starts, is fingerprinted by sliding bit counts, and
looked up in multi-index tables: two fingerprints within the radius differ by at most radius // BLOCKS bits in one block
of 64 / BLOCKS bits at least, half of which the tables hold spelled out and half of which the lookup does. So the lookup
finds all items of its size within the radius. Those are verified by the exact similarity of weighted shingles: the sum
of the smaller counts over the sum of the larger ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import fresh
from .chains import MARKS
from .common import Words, mixed, shingles, slices, unlike

#: Items, and bytes of them, whose tables are broadcast together; more are taken in further blocks, each over all documents.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Blocks of 16 bits of a fingerprint, each with tables of its own.
BLOCKS = 4
#: Shingles that are fingerprinted, and probes that are made, at a time.
AT_ONCE, PROBES = 1 << 15, 1 << 21
BITS = 64 // BLOCKS


def unpacked(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each hash."""
    return np.unpackbits(mixed(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(ones: np.ndarray, of: int) -> np.ndarray:
    """Fingerprints by how many of `of` hashes have each bit."""
    return np.packbits(2 * ones > of, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(hashes: np.ndarray) -> int:
    return int(packed(unpacked(hashes).sum(0, dtype=np.int64)[None], len(hashes))[0])


def sliding(h: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows' places in starts, their fingerprints) of all windows of `size` hashes from sorted starts on.

    Bits are counted once for each hash that is in any of the windows at hand, and a window's counts are a difference of two sums."""
    new = np.minimum(size, np.diff(starts, prepend=-size))  # hashes that a window adds to those before it
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(np.cumsum(new[low:]), AT_ONCE, "right")) + low)
        own = new[low:high].copy()
        own[0] = size
        ends = np.cumsum(own)
        of = np.repeat(starts[low:high] + size - ends, own) + np.arange(ends[-1])
        sums = np.zeros((len(of) + 1, 64), np.int32)
        np.cumsum(unpacked(h[of]), axis=0, out=sums[1:])
        yield np.arange(low, high), packed(sums[ends] - sums[ends - size], size)
        low = high


def spelled(bits: int) -> np.ndarray:
    """All numbers of BITS bits of which `bits` or fewer are set."""
    return np.array([sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(BITS), n)], np.int64)


class Tables:
    """The fingerprints of items of one size, to be found within a radius.

    Of each block of bits, the sorted values that items have, or are a few bits from, lead to the items; a map of 2^BITS
    bits tells which values there are. So a size takes 8 KB a block and what its own items need."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: int):
        self.items, self.prints, self.radius = items, prints, radius
        share = radius // BLOCKS
        self.asked, held = spelled(share - share // 2), spelled(share // 2)
        self.there, self.values, self.starts, self.posts = [], [], [], []
        for b in range(BLOCKS):
            keys = (self.block(prints, b)[:, None] ^ held).ravel()
            order = np.argsort(keys, kind="stable")
            values, starts = np.unique(keys[order], return_index=True)
            there = np.zeros(1 << BITS, bool)
            there[values] = True
            self.there.append(np.packbits(there, bitorder="little"))
            self.values.append(values.astype(np.uint16))
            self.starts.append(np.append(starts, len(keys)).astype(np.int32))
            self.posts.append(np.repeat(np.arange(len(items), dtype=np.int32), len(held))[order])

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * BITS)).astype(np.int64) & ((1 << BITS) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place of a print, item) within the radius, sorted."""
        found = [np.zeros((0, 2), np.int64)]
        for low in range(0, len(prints), most := max(1, PROBES // len(self.asked))):
            own = prints[low : low + most]
            for b, (there, values, starts, posts) in enumerate(zip(self.there, self.values, self.starts, self.posts)):
                keys = (self.block(own, b)[:, None] ^ self.asked).ravel()
                some = np.flatnonzero((there[keys >> 3] >> (keys & 7).astype(np.uint8)) & 1)
                place = np.searchsorted(values, keys[some].astype(np.uint16))
                n, of = (starts[place + 1] - starts[place]).astype(np.int64), some // len(self.asked)
                at = posts[np.arange(n.sum()) + np.repeat(starts[place] - (np.cumsum(n) - n), n)]
                of = np.repeat(of, n)
                keep = np.bitwise_count(own[of] ^ self.prints[at]) <= self.radius
                found.append(np.unique(np.column_stack((of[keep] + low, at[keep])), axis=0))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], self.items[both[:, 1]]


class Scanned:
    """Few fingerprints of items of one size, each with a radius of its own, to be compared one by one."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: np.ndarray):
        self.items, self.prints, self.radius = items, prints, radius

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = max(1, PROBES // len(self.items))
        found = [np.argwhere(np.bitwise_count(prints[low : low + most, None] ^ self.prints) <= self.radius) + (low, 0) for low in range(0, len(prints), most)]
        both = np.concatenate(found)
        return both[:, 0], self.items[both[:, 1]]


def loose(hashes: np.ndarray, threshold: float) -> int:
    """How many bits of the bag's fingerprint can differ in that of a bag of as many hashes or fewer that is as similar as the threshold.

    Such a bag lacks at most a share of (1 - t) / (1 + t) of both bags' hashes, and a bit is firm if it has a greater
    majority. Of an item that repeats a few shingles most bits are firm, or else tied, and tied ones flip together."""
    margin = np.abs(2 * unpacked(hashes).sum(0, dtype=np.int64) - len(hashes))
    return int((margin <= 2 * len(hashes) * (1 - threshold) / (1 + threshold) + 1e-9).sum())


class Items:
    """Shingles and fingerprint tables of a block of items. Items with as few loose bits as twice the radius are found whatever
    of these differ: where they are more than the radius, by comparing with each such item."""

    def __init__(self, texts: pa.Array, words: int, radius: int, threshold: float):
        w = Words(texts, split=MARKS)
        self.size = w.counts
        self.span = np.minimum(self.size, words)  # shorter items are one shingle of all their words
        self.radius = radius
        self.bags: list[Counter] = [Counter()] * len(texts)
        self.prints = np.zeros(len(texts), np.uint64)
        #: By the words of a shingle: all shingles of such items, sorted, and of each the sizes of the items that have it.
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.tables: dict[int, list[Tables | Scanned]] = {}
        may = np.zeros(len(texts), np.int64)
        for n in sorted(set(self.span.tolist()) - {0}):
            h, _ = shingles(w, n)
            having = []
            for j in np.flatnonzero(self.span == n):
                own = h[w.first[j] : w.first[j + 1] - n + 1]
                self.prints[j], self.bags[j], may[j] = fingerprint(own), Counter(own.tolist()), loose(own, threshold)
                having.append(np.column_stack((own, np.full(len(own), self.size[j], np.uint64))))
            pairs = np.unique(np.concatenate(having), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.known[n] = keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
            for size in np.unique(self.size[self.span == n]).tolist():
                fragile = (may > radius) & (may <= 2 * radius)
                own, few = np.flatnonzero((self.size == size) & ~fragile), np.flatnonzero((self.size == size) & fragile)
                self.tables[size] = [Tables(own, self.prints[own], radius)] * bool(len(own)) + [Scanned(few, self.prints[few], may[few])] * bool(len(few))


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def windows(items: Items, w: Words, n: int, h: np.ndarray, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(items' size in words, shingles of a window, sorted starts) of all windows that can be as similar as the threshold to an item.

    A text shorter than an item is one window. Of a window with m shingles and an item with k, t / (1 + t) of m + k must
    be in both, so at least as many of the window's places must have a shingle of an item of that size."""
    keys, begins, sizes = items.known[n]
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    inside = np.zeros(len(h), bool)
    inside[: len(h) - n + 1] = w.doc[: len(h) - n + 1] == w.doc[n - 1 :]
    place = np.flatnonzero((keys[at] == h) & inside)
    if not len(place):
        return
    many = begins[at[place] + 1] - begins[at[place]]
    size = sizes[np.arange(many.sum()) + np.repeat(begins[at[place]] - (np.cumsum(many) - many), many)]
    place = np.repeat(place, many)
    order = np.argsort(size, kind="stable")  # places stay in order
    size, place = size[order], place[order]
    for k, low, high in zip(*(x.tolist() for x in np.unique(size, return_index=True)), np.append(np.flatnonzero(np.diff(size)) + 1, len(size)).tolist()):
        own = place[low:high]
        docs, met = np.unique(w.doc[own], return_counts=True)
        m = np.minimum(w.counts[docs], k) - n + 1  # shingles of a window
        need = np.ceil(threshold / (1 + threshold) * (m + k - n + 1) - 1e-9).astype(np.int64)
        some = (m > 0) & (met >= need) & (m >= need)
        docs, m, need = docs[some], m[some], need[some]
        if not len(docs):
            continue
        count = w.counts[docs] - n + 1 - m + 1  # of windows
        starts = np.repeat(w.first[docs] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        length, need = np.repeat(m, count), np.repeat(need, count)
        enough = np.searchsorted(own, starts + length) - np.searchsorted(own, starts) >= need
        for one in np.unique(length[enough]).tolist():
            yield k, one, starts[enough & (length == one)]


def hits(items: Items, texts: pa.Array, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text's place, item's place) of all pairs with a window as similar as the threshold: the best similarity, its first word, its words; of several, the first."""
    w = Words(texts, split=MARKS)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for n in items.known:
        h, _ = shingles(w, n)
        for size, m, starts in windows(items, w, n, h, threshold):
            for of, prints in sliding(h, starts, m):
                last, bag = -1, Counter()
                near = zip(*(np.concatenate(x).tolist() for x in zip(*(t.near(prints) for t in items.tables[size]))))
                for k, j in near:
                    start = int(starts[of[k]])
                    d = int(w.doc[start])
                    known = best.get((d, j), (0.0,))[0]
                    if known == 1.0:
                        continue
                    if k != last:
                        last, bag = k, Counter(h[start : start + m].tolist())
                    value = similarity(bag, items.bags[j])
                    if value >= threshold and value > known:
                        best[d, j] = value, start - int(w.first[d]), m + n - 1
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", words: int = 5, threshold: float = 0.8, radius: int = 19) -> DataFrame:
    """(key, item, similarity, first_word, n_words): the best window of every row of docs and item that are as similar as the threshold.

    Words are what stands between ASCII marks, with A-Z folded. An item of fewer words than a shingle has is one
    shingle; items and texts without words, and null ones, match nothing. Repeated rows and repeated items come out each;
    key and item may be null and of any type, and other columns are not looked at. Every window within the radius is
    found; a window as similar as the threshold is beyond it with a probability of less than one in a thousand, as at a
    similarity of 0.8 fingerprints differ in 10 bits on average and in 20 at 3.6 standard deviations. Items that repeat
    a few shingles over and over, whose fingerprints are less steady, have a radius that none is beyond (`loose`). Items
    are taken in blocks, by hash, of about ITEMS and ITEM_BYTES, each over all documents, so what is broadcast is bounded."""
    unlike(key, item.lower(), "similarity", "first_word", "n_words")
    kinds, out = (docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()), None
    for share in _blocks(benchmark, item):
        got = docs.select(key, text).mapInArrow(_search(share, words, threshold, radius, text, [key, item]), f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, similarity double, first_word long, n_words long")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", words: int = 5, threshold: float = 0.8, radius: int = 19) -> DataFrame:
    """The rows of docs, with all their columns, of which no window is as similar to an item as the threshold, as `contaminated` has it. Rows are judged where they lie, without a join; null and empty texts stay."""
    for share in _blocks(benchmark, item):
        docs = docs.mapInArrow(_kept(share, words, threshold, radius, text), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item: str) -> Iterator:
    """The items (id, text) in broadcast blocks, dealt by hash."""
    few = benchmark.select(F.col(item), F.col("text").alias(fresh("text", [item])))
    body = few.columns[1]
    n, size = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    of_block = F.pmod(F.xxhash64(body, item), F.lit(blocks))
    for b in range(blocks):
        yield benchmark.sparkSession.sparkContext.broadcast(few.where(of_block == b).toArrow())


def _built(share, column: int, *how) -> Items:
    """The items of a broadcast block, built once in each Python worker, which keeps them beside the block itself."""
    if getattr(share, "built", None) is None or share.built[0] != how:
        share.built = how, Items(share.value.column(column).combine_chunks(), *how)
    return share.built[1]


def _kept(share, words: int, threshold: float, radius: int, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(share, 1, words, radius, threshold)
        for part in slices(batches, text):
            found = {d for d, _ in hits(items, part.column(part.schema.get_field_index(text)), threshold)}
            yield part.filter(pa.array([d not in found for d in range(part.num_rows)], pa.bool_()))

    return work


def _search(share, words: int, threshold: float, radius: int, text: str, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = share.value.column(0).combine_chunks(), _built(share, 1, words, radius, threshold)
        for part in slices(batches, text):
            found = sorted(hits(items, part.column(1), threshold).items())
            rows, own = (pa.array([k[i] for k, _ in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), ids.take(own), *(pa.array([v[i] for _, v in found], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64())))], [*names, "similarity", "first_word", "n_words"])

    return work
