"""SimHash near-duplicates by bit-sliced comparison (operator 1).

Fingerprints within a radius of r bits agree in at least one of r + 1 blocks of bits (or in two of r + 2), so
each is dealt to the buckets of its blocks. Within a bucket the fingerprints stand as vertical bit planes: word
w of plane p holds bit p of 64 fingerprints. A query adds one plane after another to its distances to 64
fingerprints at a time by carry-save bitwise counters, and a word is abandoned once all 64 exceed the radius."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import fresh, lookup
from .common import Words, cut, shingles, slices, unlike
from .components import components

#: Fingerprints of one bucket that one task compares with as many others; a larger bucket is dealt to cells of two chunks.
CHUNK = 4096
#: Up to so many distinct fingerprints, r + 1 blocks are enough for small buckets.
FEW = 1 << 24
#: So many row numbers (8 bytes each) are broadcast at most; more are joined by a shuffle.
FEW_ROWS = 1 << 20
#: Nodes whose remaining pairs are verified together.
LOT = 1024
#: Words of 64 distances that are computed at once.
AT_ONCE = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int) -> int:
    """Lower-cases A-Z; a bit is 1 if it is set in over half of the shingles' hashes (XXH64, seed 42). No words: zero."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, 42)
    stops = list(accumulate((len(p) + 1 for p in parts), initial=-1))
    digest = xxhash.xxh64_intdigest
    found = [digest(whole[a + 1 : b], 42) for a, b in zip(stops, stops[words:])]
    ones = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            fps = np.fromiter((fingerprint(t, words) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x n / 64 words; n must be a multiple of 64."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").view("<u8")[:, :, 0]


def near(plane: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int, order: Sequence[int] = range(64)) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a query fingerprint and a word of 64 fingerprints, which of these are within the radius.

    Returns the places of pairs that have any, and the bit masks. The planes of `order` are added, two at a time; in
    those left out, as a bucket's own bits are, queries and lanes are known to be equal."""
    digits = radius.bit_length()
    at = np.arange(len(query))
    count = [np.zeros(len(query), np.uint64) for _ in range(digits)]
    over = ~valid[word]

    def differing(p: int) -> np.ndarray:
        return plane[p][word] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))

    for k in range(0, len(order), 2):
        a = differing(order[k])
        b = differing(order[k + 1]) if k + 1 < len(order) else np.zeros_like(a)
        either = a ^ b
        carry = (a & b) | (either & count[0])
        count[0] ^= either
        for d in range(1, digits):
            carry, count[d] = carry & count[d], carry ^ count[d]
        over |= carry
        if k % 8 == 6 and k >= radius:
            live = over | _above(count, radius) != FULL
            if not live.all():
                at, query, word, over = at[live], query[live], word[live], over[live]
                count = [c[live] for c in count]
                if not len(at):
                    break
    hits = ~(over | _above(count, radius))
    some = hits != 0
    return at[some], hits[some]


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced number is greater than the radius."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], FULL)
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            equal &= count[d]
        else:
            above |= equal & count[d]
            equal &= ~count[d]
    return above


class Forest:
    """Union-find over 0..n-1, fed with arrays; roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def met(cells: list[tuple[np.ndarray, np.ndarray | None]], radius: int, order: Sequence[int]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Cells of (fingerprints, others or None); queries are compared with the others, or with themselves.

    Returns where each lane's fingerprint stands in the cells' arrays put one after another, own before others (padding:
    -1), and batches of pairs (query's place, lane) within the radius. A pair of a cell's own comes both ways round."""
    lanes, values, words, valid, asked, at = [], [], [], [], [], 0
    total = 0
    for own, others in cells:
        side = own if others is None else others
        first = at if others is None else at + len(own)
        n = -(-len(side) // 64) * 64
        lane, value = np.full(n, -1), np.zeros(n, np.uint64)
        lane[: len(side)] = np.arange(first, first + len(side))
        value[: len(side)] = side
        words.append((total // 64, n // 64))
        valid.append(np.packbits(np.arange(n) < len(side), bitorder="little").view("<u8"))
        lanes.append(lane)
        values.append(value)
        asked.append((own, np.arange(at, at + len(own))))
        at += len(own) + (0 if others is None else len(others))
        total += n
    valid, plane = np.concatenate(valid), planes(np.concatenate(values))
    query, place = np.concatenate([q for q, _ in asked]), np.concatenate([p for _, p in asked])
    width = np.concatenate([np.full(len(q), n) for (q, _), (_, n) in zip(asked, words)])
    first = np.concatenate([np.full(len(q), s) for (q, _), (s, _) in zip(asked, words)])
    begun = np.concatenate(([0], np.cumsum(width)))

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, int(begun[-1]), AT_ONCE):
            pair = np.arange(low, min(low + AT_ONCE, int(begun[-1])))
            q = np.searchsorted(begun, pair, "right") - 1
            word = first[q] + pair - begun[q]
            at, hits = near(plane, query[q], word, valid, radius, order)
            if len(at):
                row, lane = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield place[q[at][row]], word[at][row] * 64 + lane

    return np.concatenate(lanes), batches()


def compare(cells: list[tuple[np.ndarray, np.ndarray | None]], radius: int, order: Sequence[int] = range(64)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect whatever is within the radius in a cell: a spanning forest."""
    every = np.concatenate([x for own, others in cells for x in ((own,) if others is None else (own, others))])
    forest = Forest(len(every))
    lanes, batches = met(cells, radius, order)
    for q, lane in batches:
        forest.link(q, lanes[lane])
    moved = np.flatnonzero(forest.root != np.arange(len(every)))
    a, b = every[moved], every[forest.root[moved]]
    yield a[a != b], b[a != b]


def closest(cells: list[tuple[np.ndarray, np.ndarray | None]], seconds: list[tuple[np.ndarray, np.ndarray | None]], radius: int, both: int, order: Sequence[int] = range(64), forests: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (place, place, forest) within the radius, and within `both` by the sum of both fingerprints' distances, closest pairs first in every forest's choice.

    Forest 0 connects all that is connected in a cell, and each further one what the pairs before leave connected. So as
    long as fewer than `forests` pairs across a cut turn out wrong, one across it is left. A pair that no forest of some
    batches takes is in none of more batches, so what the forests hold is merged with one batch after another."""
    first, second = _places(cells), _places(seconds)
    held = [np.zeros(0, np.int64)] * 4
    lanes, batches = met(cells, radius, order)
    for a, lane in batches:
        b = lanes[lane]
        far = np.bitwise_count(second[a] ^ second[b]) + np.bitwise_count(first[a] ^ first[b])
        keep = (far <= both) & (a != b)
        new = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep]), far[keep].astype(np.int64)
        held = _forests(*np.unique(np.column_stack([np.concatenate(x) for x in zip(held, new)]), axis=0).T, len(first), forests)
    x, y, _, f = held
    yield x, y, f


def _places(cells: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
    """A column of the cells by place: their arrays one after another, own before others."""
    return np.concatenate([x for own, others in cells for x in ((own,) if others is None else (own, others))])


def _forests(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int, forests: int) -> list[np.ndarray]:
    """(a, b, far, forest) of the pairs over 0..n-1 that edge-disjoint forests take, the closest first."""
    woods, out = [Forest(n) for _ in range(forests)], [(a[:0], a[:0], far[:0], a[:0])]
    for d in np.unique(far):
        x, y = a[far == d], b[far == d]
        for f, forest in enumerate(woods):
            left = np.ones(len(x), bool)
            while True:
                at = np.flatnonzero(left)
                rx, ry = forest.root[x[at]], forest.root[y[at]]
                at, rx, ry = at[rx != ry], rx[rx != ry], ry[rx != ry]
                if not len(at):
                    break
                _, one = np.unique(np.maximum(rx, ry), return_index=True)  # one pair for each root that is joined to another
                one = at[one]
                left[one] = False
                forest.link(x[one], y[one])
            took = ~left
            out.append((x[took], y[took], np.full(took.sum(), d), np.full(took.sum(), f)))
            x, y = x[left], y[left]
    return [np.concatenate(x) for x in zip(*out)]


def across(cells: list[tuple[np.ndarray, np.ndarray | None]], seconds: list, roots: list, radius: int, both: int, order: Sequence[int], before: list[tuple[bool, np.uint64]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (place, place) of two roots that are within the radius and within `both`, but for those that a bucket
    before has: (whether it is of the second fingerprints, its mask)."""
    first, second, root = _places(cells), _places(seconds), _places(roots)
    lanes, batches = met(cells, radius, order)
    for a, lane in batches:
        b = lanes[lane]
        keep = (a < b) & (root[a] != root[b])
        a, b = a[keep], b[keep]
        x, y = first[a] ^ first[b], second[a] ^ second[b]
        keep = np.bitwise_count(x) + np.bitwise_count(y) <= both
        other = np.bitwise_count(y) <= radius
        for of_second, mask in before:
            keep &= ~(other & (y & mask == 0)) if of_second else x & mask != 0
        yield a[keep], b[keep]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, no repeats) that connect all that are within the radius.

    Every pair within the radius is compared; of a group of many, only a spanning forest leaves a cell. A bucket of more
    than CHUNK fingerprints is dealt to cells of two chunks each, so no task holds a whole bucket."""
    fps = fps.where("fp is not null")
    blocks, agree = (radius + 1, 1) if fps.count() <= FEW else (radius + 2, 2)
    edge = np.linspace(0, 64, blocks + 1).round().astype(int)
    masks = []
    for chosen in combinations(range(blocks), agree):
        m = sum(((1 << int(edge[c + 1] - edge[c])) - 1) << int(edge[c]) for c in chosen)
        masks.append((_signed(m), [b % 64 for b in range(int(edge[chosen[0]]), 64 + int(edge[chosen[0]])) if not m >> b % 64 & 1]))
    return _cells(fps, _tables(masks), ["fp"]).mapInArrow(_work(lambda cells, t, order: compare([c[0] for c in cells], radius, order), [o for _, o in masks]), "a long, b long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _tables(masks: list[tuple[int, int]], start: int = 0) -> Column:
    """Array of (t, k): the fingerprint's bucket under each mask."""
    return F.array(*[F.struct(F.lit(start + i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, (m, _) in enumerate(masks)])


def _cells(fps: DataFrame, tables: Column, columns: list[str]) -> DataFrame:
    """fps dealt to the cells of their buckets and sorted by them: (t, k, i, j, c, columns...)."""
    keyed = fps.select(*columns, F.explode(tables).alias("x")).select(*columns, "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").count().where("count > 1")
    if (sizes.agg(F.max("count")).first()[0] or 0) > CHUNK:
        keyed = keyed.join(sizes.withColumn("n", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count"), ["t", "k"])
    else:
        keyed = keyed.withColumn("n", F.lit(1))
    chunk = F.pmod(F.xxhash64(*columns), F.col("n")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda d: F.struct(F.least(d, F.col("c")).alias("i"), F.greatest(d, F.col("c")).alias("j")))
    dealt = keyed.withColumn("c", chunk).withColumn("x", F.explode(cell)).select("t", "k", "x.i", "x.j", "c", *columns)
    return dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")


def _work(found, orders: list[Sequence[int]], names: Sequence[str] = ("a", "b")):
    """found(cells, table, order) yields arrays, the columns of `names`; a cell is a list with (own, others or None) for each column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: int, cells: list) -> Iterator[pa.RecordBatch]:
            for columns in found(cells, t, orders[t]) if cells else ():
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names)

        table, ready, weight = None, [], 0
        for name, (c, *columns) in _runs(batches):
            one = [(x, None) if name[2] == name[3] else (x[c == name[2]], x[c == name[3]]) for x in columns]
            own, others = one[0]
            if len(c) < 2 or others is not None and not (len(own) and len(others)):
                continue
            if ready and (name[0] != table or weight > AT_ONCE):
                yield from out(table, ready)
                ready, weight = [], 0
            table = name[0]
            ready.append(one)
            weight += len(own) * -(-len(own if others is None else others) // 64)
        yield from out(table, ready)

    return work


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Sorted rows (t, k, i, j, columns...) as one item for each cell (t, k, i, j); longs are taken as unsigned."""
    name, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [b.num_rows]))
        columns = [x.view(np.uint64) if x.dtype == np.int64 else x for x in (b.column(i).to_numpy() for i in range(4, b.num_columns))]
        for s, e in zip(starts, starts[1:]):
            here = tuple(key[:, s].tolist())
            if here != name:
                if name is not None:
                    yield name, [np.concatenate(x) for x in zip(*held)]
                name, held = here, []
            held.append([x[s:e].copy() for x in columns])
    if name is not None:
        yield name, [np.concatenate(x) for x in zip(*held)]


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row of docs; component_id is the smallest key that links reach, its own included.

    Rows with equal fingerprints are linked, and so are rows whose fingerprints differ in `radius` bits or fewer; empty
    and null texts have fingerprint 0 like any other. Repeated rows come out as often as they are there; a null key is
    no component's smallest unless all are null. Columns other than key and text are not looked at; a key named
    like a column of the result is refused."""
    unlike(key, "fp", "component_id")
    marked = cut(fingerprints(docs, words, key, text))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    label = cut(named.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "n", "component_id"))
    return lookup(marked, "fp", label, "f", "n").select(key, "fp", "component_id")


def sketch(text: str | None, words: int) -> tuple[int, int, int]:
    """Two independent SimHash fingerprints, from the halves of 128-bit hashes of the distinct shingles, and the sum of these hashes modulo 2^64, which tells sets apart."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0, 0, 0
    whole = b" ".join(parts)
    stops = list(accumulate((len(p) + 1 for p in parts), initial=-1))
    digest = xxhash.xxh3_128_digest
    found = {digest(whole[a + 1 : b]) for a, b in zip(stops, stops[words:])} if len(parts) > words else {digest(whole)}
    raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
    ones = np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(found), bitorder="little").view("<u8").tolist()
    return a, b, int(raw.view("<u8").sum(dtype=np.uint64))


def masks(n: int, far: int, recall: float, bucket: int = 2048) -> list[tuple[int, list[int]]]:
    """Sets of sampled bits for n fingerprints, each with the other bits: so many bits that a bucket of evenly spread
    fingerprints has about `bucket`, and so many sets that two fingerprints `far` bits apart share a bucket with
    probability `recall`. A larger bucket means fewer sets, and so less to shuffle, but more to compare."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 1) / bucket))))
    share = math.comb(64 - far, bits) / math.comb(64, bits)
    rng, out = np.random.default_rng(5), []
    for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - share))):
        chosen = {int(b) for b in rng.choice(64, bits, replace=False)}
        out.append((_signed(sum(1 << b for b in chosen)), [b for b in range(64) if b not in chosen]))
    return out


def deduplicate(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 18, both: int = 34, far: int = 14, recall: float = 0.98, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the smallest key.

    Two texts are near copies if the sets of their shingles of `words` words (A-Z folded) have a Jaccard similarity of
    `least` or more; a group is what such links reach. Candidates are found by SimHash: each text has two fingerprints,
    and is dealt to buckets of sampled bits of either, so many that two texts `far` bits apart in both share one with
    probability `recall` (at a similarity of 0.8 they are about 10 apart). Within a bucket, fingerprints are compared
    bit-sliced up to the radius, and by the sum of both distances. The closest pairs that connect a bucket are verified
    exactly; then all other pairs of a bucket that are not yet in one group. Only texts with the same set of shingles
    (both fingerprints and the sum of the hashes are equal) are taken for copies unverified. Of empty or null texts one
    stays, of repeated rows too. All columns are kept, whatever their names. Rows are numbered as they are read, and read
    more than once: they must come in the same order, as they do from files, else an error is raised."""
    spark = docs.sparkSession
    row = fresh("row", docs.columns)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rows = numbered.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(row).alias("_row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([sketch(t, words) for t in part.column(1).to_pylist()], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *(pa.array(x.copy()) for x in found.T)], ["key", "_row", "h", "fp", "second", "sum"])

    kind = docs.schema[key].dataType.simpleString()
    marked = cut(rows.withColumn("h", F.xxhash64("text")).mapInArrow(work, f"key {kind}, _row long, h long, fp long, second long, sum long"))
    distinct = cut(marked.groupBy("fp", "second", "sum").agg(F.min(F.struct("key", "_row")).alias("first")).withColumn("node", F.col("first._row")))
    sampled = masks(distinct.count(), far, recall)
    half = -(-len(sampled) // 2)

    def deal(nodes: DataFrame, *columns: str) -> DataFrame:
        sides = nodes.select("fp", "second", *columns, F.lit(0).alias("side")).union(nodes.select("second", "fp", *columns, F.lit(1)))
        return _cells(sides, F.when(F.col("side") == 0, _tables(sampled[:half])).otherwise(_tables(sampled[half:], half)), ["fp", "second", *columns])

    def found(cells: list, t: int, order: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nodes = np.concatenate([x for c in cells for x in c[2] if x is not None])
        for a, b, _ in closest([c[0] for c in cells], [c[1] for c in cells], radius, both, order):
            yield nodes[a], nodes[b]

    pairs = deal(distinct, "node").mapInArrow(_work(found, [o for _, o in sampled]), "a long, b long")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    bagged = lambda b: _bags(b, words)
    asked = pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct()
    bags = cut(rows.join(_few(asked), "_row", "left_semi").select("_row", "text").mapInArrow(bagged, "_row long, bag binary"))
    sides = pairs.join(bags.withColumnsRenamed({"_row": "a", "bag": "x"}), "a").join(bags.withColumnsRenamed({"_row": "b", "bag": "y"}), "b")
    roots = cut(components(sides.select("a", "b", "x", "y").mapInArrow(lambda b: _verified(b, least), "a long, b long")))
    # what the closest pairs left out: every pair of a bucket that is still of two groups
    bits = [np.uint64(m & 0xFFFFFFFFFFFFFFFF) for m, _ in sampled]

    def unmet(cells: list, t: int, order: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nodes = _places([c[2] for c in cells])
        before = [((i < half) != (t < half), bits[i]) for i in range(t)]
        for a, b in across([c[0] for c in cells], [c[1] for c in cells], [c[3] for c in cells], radius, both, order, before):
            yield nodes[a], nodes[b]

    grouped = distinct.join(roots, "node", "left").select("fp", "second", "node", F.coalesce("root", "node").alias("root"))
    packed = _lots(_work(unmet, [o for _, o in sampled]))
    rest = cut(deal(grouped, "node", "root").mapInArrow(packed, "a long, others binary, lot int").withColumn("lot", F.struct("lot", F.spark_partition_id().alias("of"))))
    if not rest.isEmpty():
        bags = rows.join(_few(rest.select(F.col("a").alias("_row")).distinct()), "_row", "left_semi").select("_row", "text").mapInArrow(bagged, "_row long, bag binary")
        full = rest.join(bags.withColumnRenamed("_row", "a"), "a").select("lot", "a", "others", "bag")
        more = full.groupBy("lot").applyInArrow(lambda x: _linked(x, least), "a long, b long")
        roots = components(more.union(roots.select("node", "root")))
    group = distinct.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    firsts = group.groupBy("root").agg(F.min("first").alias("stays"))
    stay = group.join(firsts, "root").where("first = stays").select(F.col("first._row").alias("_row"))
    of, h = fresh("of", [*docs.columns, row]), fresh("h", docs.columns)
    gone = cut(marked.select(F.col("_row").alias(of), F.col("h").alias(h)).join(stay, F.col(of) == F.col("_row"), "left_anti"))
    met = numbered.join(F.broadcast(gone) if gone.count() <= FEW_ROWS else gone, F.col(row) == F.col(of), "left")
    same = F.xxhash64(text) == F.col(h)
    moved = F.raise_error(F.lit("docs gave its rows in another order when it was read again")).cast("boolean")
    return met.where(F.when(F.col(of).isNull(), True).when(same, False).otherwise(moved)).drop(row, of, h)


def _few(asked: DataFrame) -> DataFrame:
    return F.broadcast(asked) if asked.count() <= FEW_ROWS else asked


def _lots(work):
    """The pairs (a, b) that work yields, packed: (a, others, lot), a row for each node of a lot, with the b of its pairs.

    A lot has the pairs of LOT nodes at most, so rows grow with the nodes of a bucket, not with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = 0
        for pairs in work(batches):
            a, b = (pairs.column(i).to_numpy() for i in (0, 1))
            at = np.argsort(a, kind="stable")
            a, b = a[at], b[at]
            heads, first = np.unique(a, return_index=True)
            stops = np.append(first, len(a))
            for low in range(0, len(heads), LOT):
                own = heads[low : low + LOT]
                held = [b[x:y].tobytes() for x, y in zip(stops[low : low + LOT], stops[low + 1 : low + LOT + 1])]
                only = np.setdiff1d(b[stops[low] : stops[low + len(own)]], own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own, only))), pa.array(held + [b""] * len(only), pa.binary()), pa.array(np.full(len(own) + len(only), lot, np.int32))], ["a", "others", "lot"])
                lot += 1

    return run


def _linked(lot: pa.Table, least: float) -> pa.Table:
    """Edges (a, b) that connect what the verified pairs of a lot connect; pairs that are connected already are not verified."""
    nodes = lot.column("a").to_numpy()
    order = np.argsort(nodes)
    nodes = nodes[order]
    bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in lot.column("bag").take(pa.array(order))]
    others = [np.frombuffer(x.as_buffer(), np.int64) for x in lot.column("others").take(pa.array(order))]
    sizes, forest, found = np.array([len(x) for x in bags]), Forest(len(nodes)), []
    for a, b in enumerate(others):
        b = np.searchsorted(nodes, b)
        b = b[forest.root[b] != forest.root[a]]
        b = b[np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b])]
        if not len(b):
            continue
        if sizes[a]:
            words = np.concatenate([bags[i] for i in b])
            at = np.minimum(np.searchsorted(bags[a], words), sizes[a] - 1)
            both = np.add.reduceat(bags[a][at] == words, np.cumsum(sizes[b]) - sizes[b], dtype=np.int64)
        else:
            both = np.zeros(len(b), np.int64)
        b = b[both >= least * (sizes[a] + sizes[b] - both)]
        forest.link(np.full(len(b), a), b)
        found += [(nodes[a], nodes[x]) for x in b]
    x, y = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(x), "b": pa.array(y)})


def _bags(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        w = Words(part.column(1))
        h, inside = shingles(w, words)
        bags = []
        for d in range(w.n_docs):
            own = h[w.first[d] : w.first[d + 1]][inside[w.first[d] : w.first[d + 1]]]
            if not len(own):  # fewer words than a shingle has
                own = shingles(w, int(w.counts[d]))[0][w.first[d] : w.first[d] + 1] if w.counts[d] else own
            bags.append(np.unique(own).tobytes())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bags, pa.binary())], ["_row", "bag"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for part in batches:
        keep = []
        for x, y in zip(part.column(2), part.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both))
        yield part.filter(pa.array(keep, pa.bool_())).select([0, 1])
