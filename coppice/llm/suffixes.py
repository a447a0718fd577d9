"""Removal of repeated byte strings by suffix arrays of shards (operator 13).

A string of `length` bytes has an anchor, the least hash of the byte runs of GRAM in it, and a second one by another hash,
so equal strings have equal anchors, and neighbouring strings mostly share theirs: a text falls into stretches of starts
with the same two. One pass counts pairs of anchors. A second sends the stretches whose pair occurs again, those that lie
side by side with one first anchor as one run, as the bytes that its strings cover, to the shard of that anchor; where a
task itself holds the same run earlier, it is known to be a repeat and isn't sent. In a shard all runs of
an anchor meet. Their texts, joined, are a string whose suffix array is made by induced sorting: suffixes are classified
as larger or smaller than the next one, the leftmost smaller ones are sorted by their substrings, recursively where
these repeat, and all others are induced from them, bucket by bucket. Permuted common prefixes then tell which
neighbours in the array share `length` bytes; of such a group all but the earliest string are repeats.

Bucket-wise induction is by vector operations on what a bucket holds, so it suits an alphabet much smaller than the
string. Where the recursion meets one of almost as many names as places, the order is found by doubling ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..sources.shared import freed
from .common import bit_map, cut, eights, hashed, joined, mixed, slices, stored, unlike

#: Bytes whose hash may be an anchor.
GRAM = 24
#: Bytes of text among which a task looks for equal runs before it sends them, and of a shard that are sorted at once.
HELD, SHARD = 16 << 20, 4 << 20
#: Bytes of runs for each task of shards.
TASK_BYTES = 32 << 20
#: Runs of one anchor that a shard takes as they are; if there are more, each of their strings goes by its own hash.
HOT_RUNS = 2048
#: Induced sorting needs so many places for each different symbol; the longest that doubling is left to.
SPARSE = 256
ROWS = "anchor long, id long, h long, start long, stop long, run binary, twice boolean"
SPANS = "id long, h long, start long, stop long"


# --- suffix arrays ---


def _smaller(t: np.ndarray) -> np.ndarray:
    """For each suffix of t, which ends with its only 0, whether it is smaller than the next one."""
    at = np.flatnonzero(t[1:] != t[:-1])
    return np.append(np.repeat(t[at + 1] > t[at], np.diff(at, prepend=-1)), True)


def _dealt(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the symbols so ordered, each one's place among its equals, and where each symbol begins."""
    order = np.argsort(symbols, kind="stable")
    own = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return order, own, np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))), first


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in an order induced from that of the leftmost smaller ones: first the larger ones by buckets upwards, then the smaller ones downwards."""
    sa = np.full(len(t), -1, np.int32)
    heads = np.concatenate(([0], ends[:-1]))
    order, own, place, _ = _dealt(t[lms])
    marks = np.bincount(own, minlength=len(ends))
    sa[ends[own] - marks[own] + place] = lms[order]
    kinds = np.flatnonzero(ends > heads)
    free = heads.copy()

    def push(found: np.ndarray, up: bool) -> None:
        j = found - 1
        j = j[(j >= 0) & (small[j] != up)]
        if len(j):
            order, own, place, first = _dealt(t[j])
            sa[free[own] + place if up else free[own] - 1 - place] = j[order]
            size = np.diff(np.append(first, len(own)))
            free[own[first]] += size if up else -size

    for c in kinds:
        low = heads[c]
        while low < free[c]:  # what stands before its own symbol comes into this bucket again
            low, found = free[c], sa[low : free[c]]
            push(found, True)
        if marks[c]:
            push(sa[ends[c] - marks[c] : ends[c]], True)
    larger, free = free.copy(), ends.copy()
    free[0] = 0
    sa[0] = len(t) - 1
    for c in kinds[::-1]:
        high = ends[c]
        while high > free[c]:
            high, found = free[c], sa[free[c] : high][::-1]
            push(found, False)
        if larger[c] > heads[c]:
            push(sa[heads[c] : larger[c]][::-1], False)
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each leftmost smaller suffix, in the order of the text, the number of its substring among all different ones; order: the suffixes sorted by these."""
    size = np.zeros(len(t), np.int64)
    size[lms] = np.diff(np.append(lms, len(t) - 1)) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    left, k = np.flatnonzero(same), 0
    while len(left):
        equal = t[a[left] + k] == t[b[left] + k]
        same[left[~equal]] = False
        left, k = left[equal], k + 1
        left = left[size[a[left]] > k]
    name = np.zeros(len(t), np.int64)
    name[order] = np.cumsum(np.concatenate(([0], ~same)))
    return name[lms]


def _doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array by doubling ranks; only what is still equal is sorted again."""
    n = len(t)
    t = t.astype(np.int64)
    order = np.argsort(t, kind="stable")
    own = t[order]
    first = np.concatenate(([True], own[1:] != own[:-1]))
    at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = at
    left, step = order[~(first & np.append(first[1:], True))], 1
    while len(left):
        key = rank[left] * (n + 1) + np.where(left + step < n, rank[np.minimum(left + step, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        left, key = left[by], key[by]
        old = rank[left]
        first, begins = np.concatenate(([True], key[1:] != key[:-1])), np.concatenate(([True], old[1:] != old[:-1]))
        places = np.arange(len(left))
        rank[left] = old + np.maximum.accumulate(np.where(first, places, 0)) - np.maximum.accumulate(np.where(begins, places, 0))
        left, step = left[~(first & np.append(first[1:], True))], 2 * step
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, sparse: int = SPARSE) -> np.ndarray:
    """The suffixes of t in order. t: whole numbers above 0 and a single 0 at the end."""
    counts = np.bincount(t)
    t = t.astype(np.uint8 if len(counts) <= 1 << 8 else np.uint16 if len(counts) <= 1 << 16 else np.int64)  # symbols of few bytes are dealt fastest
    if len(t) == 1 or np.count_nonzero(counts) * sparse > len(t):
        return _doubled(t)
    ends, small = np.cumsum(counts), _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induced(t, small, lms, ends)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    names = _names(t, lms, order)
    if names.max() + 1 < len(names):
        order = lms[suffix_array(names, sparse)]
    return _induced(t, small, order, ends)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix of t (bytes), in the order of the text, how many bytes it shares with the one before it in the array.

    Where both stand after the same byte it is one less than that of the suffix before in the text; the others are
    compared, eight bytes at a time."""
    before = np.empty(len(t), np.int32)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    fresh = np.ones(len(t), bool)
    both = np.flatnonzero(before[1:] > 0) + 1
    fresh[both] = t[both - 1] != t[before[both] - 1]
    shared, eight = np.zeros(len(t), np.int32), eights(t)
    left = np.flatnonzero(fresh & (before >= 0))
    other, k = before[left], 0
    while len(left):
        x = eight[np.minimum(left + k, len(t))] ^ eight[np.minimum(other + k, len(t))]  # ends at the only 0 at the latest
        done = x != 0
        shared[left[done]] = k + np.bitwise_count((x[done] & (~x[done] + np.uint64(1))) - np.uint64(1)).astype(np.int32) // 8
        left, other, k = left[~done], other[~done], k + 8
    places = np.arange(len(t), dtype=np.int32)
    source = np.maximum.accumulate(np.where(fresh, places, 0))
    return shared[source] - (places - source)


# --- runs ---


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each place on."""
    size = 1
    while 2 * size <= width:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


class Anchored:
    """The strings of `length` bytes of some texts by their anchors: stretches of starts with the same two, the least of two hashes.

    data, ends: the texts' bytes, and where each text and the byte after it end. at, n, anchor, both: where each stretch
    begins, how many strings start in it, their first anchor, and a hash of the two."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int):
        self.data, self.ends, self.length, self.width = data, ends, length, length - GRAM + 1
        n = len(data) - length + 1
        if n <= 0:
            self.at = self.n = np.zeros(0, np.int64)
            self.anchor = self.both = np.zeros(0, np.uint64)
            return
        eight = eights(data)
        with np.errstate(over="ignore"):
            h = eight[: len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
            for k in range(8, GRAM, 8):
                h ^= h >> np.uint64(29)
                h += eight[k : len(data) - GRAM + 1 + k]
                h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            h = mixed(h)
            one, two = _least(h, self.width), _least(h * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(32)), self.width)
        self.low = np.lib.stride_tricks.sliding_window_view(h.astype(np.uint16), self.width)
        begins = np.concatenate(([0], ends[:-1]))
        stops = ends - length  # the last string of a text starts a byte before
        some = stops > begins
        inside = np.zeros(n + 1, np.int8)
        inside[begins[some]] += 1
        inside[stops[some]] -= 1
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        new[begins[some]] = True
        self.at = np.flatnonzero(new & (np.cumsum(inside[:n], dtype=np.int8) > 0))
        self.n = np.minimum(np.append(self.at[1:], n), stops[np.searchsorted(ends, self.at, "right")]) - self.at
        self.anchor = one[self.at]
        with np.errstate(over="ignore"):
            self.both = mixed(self.anchor + two[self.at] * np.uint64(0x9E3779B97F4A7C15))

    def twice(self, at: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whether its first anchor stands in a stretch twice, as where a string is repeated within it. Sixteen bits of the hashes tell, so it may be said of others."""
        if not len(at):
            return np.zeros(0, bool)
        own = anchor.astype(np.uint16)[:, None]
        return np.argmax(self.low[at] == own, axis=1) + np.argmax(self.low[at + n - 1][:, ::-1] == own, axis=1) != n + self.width - 2

    def runs(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, n, anchor) of the stretches kept, neighbours with the same first anchor as one."""
        at, n, anchor = self.at[kept], self.n[kept], self.anchor[kept]
        if not len(at):
            return at, n, anchor
        # texts are a byte apart or more, so stretches that touch are of one text
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + n[:-1]) | (anchor[1:] != anchor[:-1]))))
        return at[first], np.add.reduceat(n, first), anchor[first]


class Place:
    """Which of some strings is earlier: by id, null last, then by the text's hash, then by start. Rows with the same id and text are one document."""

    def __init__(self, ids: pa.Array, h: np.ndarray):
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids, self.h = ids.fill_null(0).to_numpy(zero_copy_only=False), h
        order = np.lexsort((self.h, self.ids, self.none))
        new = np.concatenate(([False], np.any([c[order][1:] != c[order][:-1] for c in (self.none, self.ids, self.h)], axis=0)))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new)[: len(order)]

    def column(self, rows: np.ndarray) -> pa.Array:
        return pa.array(self.ids[rows], pa.int64(), mask=self.none[rows])


def firsts(code: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest row of each code, and the rows that repeat it at a later place (not the same place once more)."""
    order = np.lexsort((start, rank, code))
    c = code[order]
    new = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
    first = order[np.flatnonzero(new)]
    of = first[np.cumsum(new) - 1] if len(c) else first
    return first, order[(rank[order] != rank[of]) | (start[order] != start[of])]


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each doc, those that touch or overlap as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    wide = int(stop.max()) + 2
    reach = np.maximum.accumulate(doc * wide + stop)
    new = np.concatenate(([True], doc[1:] * wide + start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def _rows(place: Place, anchor: np.ndarray | None, rows: np.ndarray, start: np.ndarray, stop: np.ndarray, texts: pa.Array | None, twice: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)), place.column(rows), pa.array(place.h[rows]), pa.array(start), pa.array(stop), pa.nulls(n, pa.binary()) if texts is None else texts, pa.array(np.zeros(n, bool) if twice is None else twice)],
        ["anchor", "id", "h", "start", "stop", "run", "twice"],
    )


def _binary(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[index])])


def _sent(place: Place, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, texts: pa.Array, twice: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The earliest of equal texts as runs to be sent on, the others as spans that are repeats."""
    code = texts.dictionary_encode().indices.to_numpy()
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    first, again = firsts(code, place.rank[doc], start)
    for low in range(0, len(first), 1 << 13):
        some = first[low : low + (1 << 13)]
        yield _rows(place, anchor[some], doc[some], start[some], start[some] + size[some], texts.take(pa.array(some)), None if twice is None else twice[some])
    d, a, b = merged(doc[again], start[again], start[again] + size[again])
    if len(d):
        yield _rows(place, None, d, a, b, None)


def runs(rows: DataFrame, length: int, known: tuple) -> DataFrame:
    """The runs of rows (id, h, text) whose anchors are in the map of repeated ones, as ROWS; a null run is a span that is a repeat."""
    shared, log = known

    def lot(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, h = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first = np.concatenate(([0], np.cumsum([len(p[1]) for p in parts])))
        doc = np.concatenate([p[2] + f for p, f in zip(parts, first)])
        yield from _sent(Place(ids, h), doc, np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]), pa.concat_arrays([p[5] for p in parts]), np.concatenate([p[6] for p in parts]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts, size = shared.value, [], 0
        for part in slices(batches):
            data, ends = joined(part.column(2))
            all_ = Anchored(data, ends, length)
            spot = all_.both >> np.uint64(64 - log)
            at, n, anchor = all_.runs(np.flatnonzero((bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1))
            doc = np.searchsorted(ends, at, "right")
            parts.append((part.column(0), part.column(1).to_numpy(), doc, at - np.concatenate(([0], ends))[doc], anchor, _binary(data, at, n + length - 1), all_.twice(at, n, anchor)))
            size += len(data)
            if size >= HELD:
                yield from lot(parts)
                parts, size = [], 0
        if parts:
            yield from lot(parts)

    return rows.mapInArrow(gather, ROWS)


def anchors(rows: DataFrame, length: int) -> DataFrame:
    """(h, n): a hash of every pair of anchors in rows (id, h, text), and how many stretches have it; one with its anchor twice counts as two."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            all_ = Anchored(*joined(part.column(2)), length)
            own, n = np.unique(np.concatenate((all_.both, all_.both[all_.twice(all_.at, all_.n, all_.anchor)])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["h", "n"])

    return rows.mapInArrow(gather, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def single(hot: DataFrame, length: int) -> DataFrame:
    """Every string of the runs by itself, its own hash as its anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "run", SHARD // 16):
            texts = part.column(5)
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            n = np.diff(ends) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = ends[row] + inner
            place = Place(part.column(1), part.column(2).to_numpy())
            yield from _sent(place, row, part.column(3).to_numpy()[row] + inner, hashed(data, begin, begin + length), _binary(data, begin, np.full(len(begin), length)))

    return hot.mapInArrow(work, ROWS)


def repeats(part: pa.RecordBatch | pa.Table, length: int) -> tuple[Place, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, document, start, stop) of the strings in these rows (ROWS) that stand earlier in them, too."""
    place = Place(part.column("id").combine_chunks(), part.column("h").to_numpy())
    start, texts = part.column("start").to_numpy(), part.column("run").combine_chunks()
    size = part.column("stop").to_numpy() - start
    first, again = firsts(texts.dictionary_encode().indices.to_numpy(), place.rank, start)
    out = [(again, start[again], start[again] + size[again])]
    anchor = part.column("anchor").to_numpy()[first]
    _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
    # equal texts are one by now; one that is alone with its anchor, which stands in it once, has nothing to be compared with
    met = first[(times[which] > 1) | part.column("twice").to_numpy()[first]]
    met = met[np.lexsort((start[met], place.rank[met]))]  # then the earlier of two strings stands before the other in the joined text
    if len(met):
        raw = b"".join(x + b"\xff" for x in texts.take(pa.array(met)).to_pylist())  # no UTF-8 text has this byte
        t = np.frombuffer(raw + b"\xff", np.uint8) + np.uint8(1)  # 0 at the end
        t[:-1][t[:-1] == 0] = 255  # between runs
        ends = np.cumsum(size[met] + 1)
        sa = suffix_array(t)
        shared = common_prefixes(t, sa)
        run = np.minimum(np.searchsorted(ends, sa, "right"), len(met) - 1)
        whole = sa + length < ends[run]  # within its run
        new = (shared[sa] < length) | ~whole
        group = np.flatnonzero(new)
        earliest = np.minimum.reduceat(sa, group)[np.cumsum(new) - 1]
        late = np.flatnonzero(whole & (sa != earliest))
        at, row = sa[late], met[run[late]]
        begin = start[row] + at - (ends - size[met] - 1)[run[late]]
        out.append((row, begin, begin + length))
    doc, a, b = (np.concatenate(x) for x in zip(*out))
    return (place, *merged(doc, a, b))


def shards(found: DataFrame, length: int, tasks: int) -> DataFrame:
    """The spans (SPANS) of strings that repeat earlier ones with the same anchor. A shard takes whole anchors, which have about HOT_RUNS runs at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD:
                rows = pa.Table.from_batches(held).combine_chunks()
                anchor = rows.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))  # the last one may go on
                if whole:
                    yield from spans(rows.slice(0, whole).combine_chunks())
                held = rows.slice(whole).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held) if whole else 0
        if held:
            yield from spans(pa.Table.from_batches(held).combine_chunks())

    def spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        place, doc, a, b = repeats(rows, length)
        yield pa.RecordBatch.from_arrays([place.column(doc), pa.array(place.h[doc]), pa.array(a), pa.array(b)], ["id", "h", "start", "stop"])

    return found.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(work, SPANS)


def repeated(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, start, stop): spans of bytes, of the texts with this id and xxhash64, that are covered by strings of `length` bytes which start earlier as well.

    Earlier is in a text of smaller id (null ids last; of one id, by the hash of the text), or further ahead in the same
    one. Rows with the same id and text are one document. Spans of a text may touch or overlap. Strings don't cross
    texts; a null text is empty. The key must be a whole number."""
    if length < GRAM + 8:
        raise ValueError(f"strings must have {GRAM + 8} bytes or more")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("h"), t.alias("text")).where(F.octet_length("text") >= length)
    spark = docs.sparkSession
    bits = bit_map(cut(anchors(rows, length).where("n > 1").select("h")))
    if bits is None:
        return spark.createDataFrame([], SPANS)
    freed(spark)  # the counts' shuffle is as long as the texts
    with stored(runs(rows, length, (spark.sparkContext.broadcast(bits[0]), bits[1]))) as found:
        sent = found.where("run is not null")
        label = cut(sent.groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_RUNS))
        told = lookup(sent, "anchor", label, "of", "n")
        split = cut(single(told.where("n is not null").drop("of", "n"), length)) if label.count() else None
        total = sent.agg(F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).first()[0]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
        cold = told.where("n is null").drop("of", "n")
        every = cold if split is None else cold.unionByName(split.where("run is not null"))
        out = found.where("run is null").select("id", "h", "start", "stop").unionByName(shards(every, length, tasks))
        if split is not None:
            out = out.unionByName(split.where("run is null").select("id", "h", "start", "stop"))
        out = cut(out)
    freed(spark)
    return out


def deduplicate(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of docs: key, spans (array of start and stop, of bytes, in order, none touching another), kept (the bytes outside of them).

    What counts as repeated: see `repeated`. A cut may leave part of a character, so kept is binary. Other columns don't matter."""
    unlike(key, "spans", "kept", "id", "h", "text", "start", "stop", "_key", "_text")
    found = repeated(docs, length, key, text).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.xxhash64(t).alias("h"), t.alias("text"))
    both = rows.join(found, rows[key].cast("long").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select(key, "text", "found")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans, kept = [], []
            for raw, own in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                _, a, b = merged(*np.array([(0, x["start"], x["stop"]) for x in own or []], np.int64).reshape(-1, 3).T)
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b)])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], [key, "spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(work, f"`{key}` {kind}, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def digest(deduplicated: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of the rows of `deduplicate`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return deduplicated.select(key, (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

