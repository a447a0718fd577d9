"""Language-model scoring from a log-frequency Bloom filter (operator 2).

Counts of words and word pairs are gathered over all training rows as packed, sorted runs: each task sums what it has
read, a lot of rows at a time, and sends every range of hashes on as one binary row. The task of a range merges the
runs, writes its segment of the filter, and probes it for every n-gram of every run, those of held-out rows included;
the levels go back to the lots as a byte for each n-gram. An n-gram of count c is in the filter under the levels 1 to
1 + floor(log2 c), and a probe tries level after level until one is missing. A segment has BITS bits for each (n-gram,
level) in it, so its error is the same for any size of the corpus, and nobody holds more of the filter than a segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mixed, pairs_hash, remainders, slices, unlike

#: Hash of the end of a text, which also stands before the first word.
END = np.uint64(0x5851F42D4C957F2D)
#: Hash functions of a membership test.
PROBES = 3
#: Bits of the filter for each (n-gram, level) that is in it: 9 % of them are set, and fewer than one in a thousand absent ones found.
BITS = 32
#: Bytes of text whose tokens a task sums before it sends them on, as one lot.
HELD = 12 << 20
#: Bytes of runs that a range is to hold, and of runs for each byte of text (12 for each word and pair of a lot).
RANGE_BYTES, RUN_SHARE = 1 << 28, 3
#: Added to every count of the smoothed word probabilities.
ADD = 0.1
#: Exact counts of so many words at most are broadcast; the others are joined.
FREQUENT = 1 << 19
MEAN = np.array([0.0] + [1.5 * 2 ** (q - 1) - 0.5 for q in range(1, 64)])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an end after each text, and where each text begins (and all end)."""
    w = Words(texts)
    return np.insert(w.hash, w.first[1:], END), w.first + np.arange(w.n_docs + 1)


def before(t: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first one, the end of another."""
    return np.concatenate(([END], t[:-1])) if len(t) else t


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def places(h: np.ndarray, level: int, k: int, ranges: int, segment: int) -> np.ndarray:
    """Bit of the filter for an n-gram at a level and hash function; all of an n-gram's bits are in the segment of its range."""
    with np.errstate(over="ignore"):
        x = mixed(h + np.uint64(level * PROBES + k) * np.uint64(0x9E3779B97F4A7C15))
    return _range_of(h, ranges) * np.uint64(segment) + x % np.uint64(segment)


def lots(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Slices of rows (key, text, row number) with about HELD bytes of text; a lot is named by its first row's number."""
    parts, size = [], 0
    for part in slices(batches, text):
        parts.append(part)
        size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
        if size >= HELD:
            yield parts[0].column(2)[0].as_py(), parts
            parts, size = [], 0
    if parts:
        yield parts[0].column(2)[0].as_py(), parts


def counts(docs: DataFrame, ranges: int, held_out: int, folds: int, key: str, text: str) -> DataFrame:
    """(lot, n, r, total, levels, words, times) of rows (key, text, row number).

    For every lot, n and range of hashes the level of each of the lot's n-grams, in the order of their hashes, and the sum of
    these; and with n = 0 for every range the exact counts of its words."""

    def run(lot: int, order: int, keys: np.ndarray, others: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = _summed(keys)
        others = np.setdiff1d(others, keys)  # asked for, but not learned
        keys, n = np.concatenate((keys, others)), np.concatenate((n, np.zeros(len(others), np.int64)))
        at = np.argsort(keys, kind="stable")
        keys, n = keys[at], n[at].astype(np.int32)
        edges = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
        some = np.flatnonzero(edges[1:] > edges[:-1])
        for part in np.array_split(some, max(1, len(some) // 64)):
            rows = [(keys[edges[r] : edges[r + 1]].tobytes(), n[edges[r] : edges[r + 1]].tobytes()) for r in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), lot)), pa.array(part.astype(np.int32)), pa.array(np.full(len(part), order, np.int32)), pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["lot", "r", "n", "keys", "times"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, parts in lots(batches, text):
            one, two, learned = [], [], []
            for part in parts:
                fold = remainders(part.column(0).to_pylist(), folds)
                t, begins = tokens(part.column(1))
                one.append(t)
                two.append(pairs_hash(before(t), t))
                learned.append(np.repeat([f is not None and f != held_out for f in fold], np.diff(begins)))
            learned = np.concatenate(learned)
            for order, held in ((1, one), (2, two)):
                held = np.concatenate(held)
                yield from run(lot, order, held[learned], held[~learned])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, runs = None, {1: [], 2: []}
        for batch in batches:
            for lot, r, n, k, c in zip(*(batch.column(i) for i in range(5))):
                if here is not None and r.as_py() != here:
                    yield from written(here, runs)
                    runs = {1: [], 2: []}
                here = r.as_py()
                runs[n.as_py()].append((lot.as_py(), np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int32)))
        if here is not None:
            yield from written(here, runs)

    def written(r: int, runs: dict) -> Iterator[pa.RecordBatch]:
        summed = {n: _summed(np.concatenate([k for _, k, _ in parts]), np.concatenate([c for _, _, c in parts]).astype(np.int64)) for n, parts in runs.items() if parts}
        bits = segment(list(summed.values()))
        words = [x[summed[1][1] > 0] for x in summed[1]] if 1 in summed else [np.zeros(0, np.int64)] * 2
        rows = [(None, 0, r, None, None, *(x.tobytes() for x in words))]
        for n, (keys, _) in summed.items():
            level = probe(bits, keys, 1, 8 * len(bits)).astype(np.uint8)
            rows += [(lot, n, r, int(own.sum(dtype=np.uint64).view(np.int64)), level[np.searchsorted(keys, own)].tobytes(), None, None) for lot, own, _ in runs[n]]
        for low in range(0, len(rows), 64):
            columns = zip(*rows[low : low + 64])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["lot", "n", "r", "total", "levels", "words", "times"])

    runs = docs.mapInArrow(gather, "lot long, r int, n int, keys binary, times binary")
    return runs.repartition(max(1, ranges // 4), "r").sortWithinPartitions("r").mapInArrow(merge, "lot long, n int, r int, total long, levels binary, words binary, times binary")


def segment(grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The filter of n-grams (hashes, counts), packed; it has as many bits as it needs for them. Counts of 0 are left out."""
    tops = [np.frexp(times.astype(float))[1] for _, times in grams]
    size = max(64, -(-BITS * sum(int(top.sum()) for top in tops) // 8) * 8)
    bits = np.zeros(size, bool)
    for (left, _), top in zip(grams, tops):
        level = 1
        while len(left):
            more = top >= level
            left, top = left[more], top[more]
            for k in range(PROBES):
                bits[places(left, level, k, 1, size)] = True
            level += 1
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, h: np.ndarray, ranges: int, segment: int) -> np.ndarray:
    """The level under which each n-gram is found, probing one level after another; 0: not in the filter."""
    level = np.zeros(len(h), np.int64)
    at, q = np.arange(len(h)), 1
    while len(at) and q < len(MEAN):
        for k in range(PROBES):
            p = places(h[at], q, k, ranges, segment)
            at = at[(bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        level[at] = q
        q += 1
    return level


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = 0, folds: int = 10, weight: float = 20.0) -> DataFrame:
    """One row for every row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score takes exact counts of words; score is the text's log10 probability under word pairs, by counts probed
    from the filter: (c(vw) + weight p(w)) / (c(v) + weight), where p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). A null or
    empty text is its end alone; a row with a null key is not held out (held_out is null) and not learned from.
    Without any training tokens all counts are 0. docs is read twice and must give its rows in the same order, as files
    do; else the levels of a lot don't fit it, which raises an error. Ranges are as many as the bytes of text ask for, so
    that none holds more than about RANGE_BYTES; a word that the filter doesn't have needs no join for its exact count, 0."""
    unlike(key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "sure", "base", "rare", "row")
    spark = docs.sparkSession
    rows = docs.select(key, text, F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * RUN_SHARE // RANGE_BYTES))
    gathered = cut(counts(rows, ranges, held_out, folds, key, text))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64))], ["h", "c"])

    known = gathered.where("n = 0").select("words", "times").mapInArrow(unpack, "h long, c long")
    step = known.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("s"), F.min("c").alias("least")).collect()
    total, vocabulary = sum(r["s"] for r in step), sum(r["n"] for r in step)
    least, held = None, 0
    for r in sorted(step, key=lambda r: -r["step"]):
        if held + r["n"] > FREQUENT:
            break
        held, least = held + r["n"], r["least"]
    often = (known.where(F.col("c") >= least) if least else known.limit(0)).toArrow()
    order = np.argsort(h := often.column("h").to_numpy().view(np.uint64))
    share = spark.sparkContext.broadcast((h[order], often.column("c").to_numpy()[order]))
    below = total + ADD * (vocabulary + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, parts in lots(batches, text):
            for part in parts:
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lot]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["lot", "part"])

    def work(packed: pa.Table, answers: pa.Table) -> pa.Table:
        frequent, seen = share.value
        parts = [b for x in packed.column("part") for b in pa.ipc.open_stream(x.as_buffer())]
        met = [tokens(part.column(1)) for part in parts]
        one = [np.unique(t, return_inverse=True) for t, _ in met]
        two = [np.unique(pairs_hash(before(t), t), return_inverse=True) for t, _ in met]
        answers = answers.sort_by([("n", "ascending"), ("r", "ascending")])
        unique, level = {}, {}
        for n, some in ((1, one), (2, two)):
            own = answers.filter(pc.equal(answers.column("n"), n))
            unique[n], level[n] = np.unique(np.concatenate([u for u, _ in some])), np.frombuffer(b"".join(own.column("levels").to_pylist()), np.uint8)
            if len(unique[n]) != len(level[n]) or unique[n].sum(dtype=np.uint64) != own.column("total").to_numpy().view(np.uint64).sum(dtype=np.uint64):
                raise RuntimeError("docs gave its rows in another order when it was read again")
        of = lambda n, u: MEAN[level[n][np.searchsorted(unique[n], u)]]
        out = [scored(part, *m, *a, of(1, a[0]), of(2, b[0])[b[1]], frequent, seen) for part, m, a, b in zip(parts, met, one, two)]
        return pa.Table.from_batches(out)

    def scored(part: pa.RecordBatch, t: np.ndarray, begins: np.ndarray, unique: np.ndarray, back: np.ndarray, own: np.ndarray, pair: np.ndarray, frequent: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        c = np.zeros(len(unique))
        at = np.minimum(np.searchsorted(frequent, unique), max(len(frequent) - 1, 0))
        found = frequent[at] == unique if len(frequent) else np.zeros(len(unique), bool)
        c[found] = seen[at[found]]
        exact = np.log10((c + ADD) / below)
        p = (own + ADD) / below
        v = np.concatenate(([np.searchsorted(unique, END)], back[:-1]))
        pair = np.minimum(pair, own[v])
        model = np.log10(np.minimum((pair + weight * p[back]) / (own[v] + weight), 1.0))
        rare = ~found & (own > 0)  # what the filter doesn't have was never learned from; the rest of the others is counted exactly
        base = np.add.reduceat(np.where(rare[back], 0.0, exact[back]), begins[:-1])
        n, sure = np.diff(begins), np.add.reduceat(found[back].astype(np.int64), begins[:-1])
        asked, times = np.unique(np.repeat(np.arange(len(n)), n)[rare[back]] * len(unique) + back[rare[back]], return_counts=True)
        ends = np.searchsorted(asked, np.arange(len(n) + 1) * len(unique)).astype(np.int32)
        asked = pa.StructArray.from_arrays([pa.array(unique[asked % len(unique)].view(np.int64)), pa.array(times)], ["w", "times"])
        fold, rest = remainders(part.column(0).to_pylist(), folds), pa.ListArray.from_arrays(pa.array(ends), asked)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([None if f is None else f == held_out for f in fold], pa.bool_()), pa.array(n), pa.array(sure), pa.array(base), pa.array(np.add.reduceat(model, begins[:-1])), rest], names)

    names = [key, "held_out", "n_tokens", "sure", "base", "score", "rare"]
    kind = docs.schema[key].dataType.simpleString()
    packed = rows.mapInArrow(pack, "lot long, part binary").groupBy("lot")
    answers = gathered.where("n > 0").select("lot", "n", "r", "total", "levels").groupBy("lot")
    first = packed.cogroup(answers).applyInArrow(work, f"`{key}` {kind}, held_out boolean, n_tokens long, sure long, base double, score double, rare array<struct<w:bigint,times:bigint>>")
    first = cut(first.withColumn("row", F.monotonically_increasing_id()))
    asked = first.select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.times")
    less = known.where(F.col("c") < least) if least else known
    met = asked.join(less, F.col("w") == F.col("h"), "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(ADD)) / F.lit(below))
    rest = met.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("times") * log).alias("more"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0)).alias("known"))
    return first.join(rest, F.col("row") == F.col("of"), "left").select(
        key, "held_out", "n_tokens", (F.col("sure") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"
    )
