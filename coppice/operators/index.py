"""A kept inverted index: posting lists in delta-coded blocks, changed block by block, searched without reading blocks that can't matter.

A block is a row (token, first, last, n, ids): n leaf ids in order, the first as it is, then the differences in as few
bytes as the largest of them needs. The blocks of a token don't overlap, so an id can only be in the last block that
begins at it or before it; for searches that one is found by a fill over ranges of (token, id). Leaves are gathered into
lists where they lie, and lists are merged into blocks: a new index by token and range of ids, an update by token, whose
blocks and changes a task goes through range by range, holding no list whole. A DataFrame of blocks is the index; as
Parquet files sorted by token (`save`) its rows are pruned by the tokens asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .scan import numbered

#: Ids of a block at most.
BLOCK = 512
BLOCKS = "token string, first long, last long, n long, ids binary"
#: Lists of ids on their way into blocks: part numbers ranges of ids, kind is 0 for blocks that are there, 1 and -1 for ids to put in or take out.
LISTS = "token string, part long, kind int, first long, last long, n long, ids binary"
#: Leaves of a range of ids.
SPAN = 1 << 18
#: Tokens of leaves that a task gathers into lists at a time, and ids that it merges.
GATHER, MERGED = 1 << 21, 1 << 20
#: Changed tokens that are broadcast at most.
FEW = 1 << 17


def encoded(ids: np.ndarray) -> bytes:
    """Ids in order as the width of a difference and the differences."""
    step = np.diff(ids)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(step) or step.max() < 1 << 8 * w)
    return bytes([width]) + step.astype(f"<u{width}").tobytes()


def decoded(first: int, data: bytes) -> np.ndarray:
    return np.concatenate(([first], first + np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)))


def packed(ids: np.ndarray, start: np.ndarray) -> pa.Array:
    """Of runs of ids in order, which begin at `start`, each one's `encoded`, all at once."""
    size = np.diff(np.append(start, len(ids)))
    step = np.diff(ids, prepend=ids[:1])
    step[start] = 0
    most = np.maximum.reduceat(step.view(np.uint64), start)
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    end = np.cumsum(1 + width * (size - 1))
    begin = end - (1 + width * (size - 1))
    out = np.zeros(int(end[-1]), np.uint8)
    out[begin] = width
    of, place = np.repeat(np.arange(len(start)), size), np.arange(len(ids)) - np.repeat(start, size)
    for w in (1, 2, 4, 8):
        some = np.flatnonzero((width[of] == w) & (place > 0))
        at = begin[of[some]] + 1 + (place[some] - 1) * w
        for k in range(w):
            out[at + k] = (step[some] >> 8 * k) & 255
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(out)])


def unpacked(first: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and how many each has: `decoded` of each, all at once."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    width = data[offset[:-1]].astype(np.int64)
    size = (np.diff(offset) - 1) // width + 1
    start = np.cumsum(size) - size
    step = np.zeros(int(size.sum()), np.int64)
    of, place = np.repeat(np.arange(len(size)), size), np.arange(len(step)) - np.repeat(start, size)
    for w in (1, 2, 4, 8):
        some = np.flatnonzero((width[of] == w) & (place > 0))
        at = offset[of[some]] + 1 + (place[some] - 1) * w
        for k in range(w):
            step[some] |= data[at + k].astype(np.int64) << 8 * k
    total = np.cumsum(step)  # may wrap around, and so may the difference that undoes it
    return total - np.repeat(total[start], size) + np.repeat(first, size), size


def ordered(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The stable order by small codes and then ids, which a single key gives unless the ids are too far apart."""
    low, high = int(ids.min()), int(ids.max())
    if (high - low + 1) * (int(code.max()) + 1) < 1 << 62:
        return np.argsort(code * (high - low + 1) + (ids - low), kind="stable")
    return np.lexsort((ids, code))


def marks_of(leaves: DataFrame) -> list[int]:
    """Ids that part all ids into ranges of about SPAN leaves (up to a thousand ranges); none where there are few leaves."""
    n, at = leaves.agg(F.count("leaf_id"), F.percentile_approx("leaf_id", [i / 1000 for i in range(1, 1000)], 10000)).first()
    parts = min(1000, -(-n // SPAN))
    return sorted({int(at[i * 1000 // parts - 1]) for i in range(1, parts)})


def lists(changes: DataFrame, marks: list[int]) -> DataFrame:
    """LISTS of leaves (leaf_id, tokens, op): each task gathers some GATHER tokens of leaves at a time into a list for each token, op and range of ids, so what is shuffled are lists and not single ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, low = np.cumsum(size), 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GATHER - n, "right")))
                held.append((batch.column(0).slice(low, high - low).to_numpy(), batch.column(2).slice(low, high - low).to_numpy(), size[low:high], pc.list_flatten(batch.column(1).slice(low, high - low)).dictionary_encode()))
                n += int(size[low:high].sum())
                low = high
                if n >= GATHER:
                    yield from gathered(held)
                    held, n = [], 0
        if n:
            yield from gathered(held)

    def gathered(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        leaf, op, size = (np.concatenate([h[i] for h in held]) for i in range(3))
        token = pa.chunked_array([h[3] for h in held]).unify_dictionaries()
        words = token.chunk(0).dictionary
        code = np.concatenate([pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in token.chunks]).astype(np.int64)
        sorted_ids, rank = np.unique(leaf, return_inverse=True)
        key = ((code * 2 + np.repeat(op > 0, size)) * len(sorted_ids) + np.repeat(rank, size))[code >= 0]
        if not len(key):
            return
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        run, ids = key // len(sorted_ids), sorted_ids[key % len(sorted_ids)]
        part = np.searchsorted(marks, ids, "right").astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (part[1:] != part[:-1]))))
        stop = np.append(start[1:], len(ids))
        kind = np.where(run[start] % 2, 1, -1).astype(np.int32)
        yield rows_of(words.take(pa.array(run[start] // 2)), part[start], kind, ids, start, stop)

    own = changes.where("leaf_id is not null").select(F.col("leaf_id").cast("long"), "tokens", F.col("op").cast("int"))
    return own.mapInArrow(work, LISTS)


def rows_of(tokens: pa.Array, part: np.ndarray, kind: np.ndarray, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """LISTS of runs of ids."""
    columns = [tokens.cast(pa.string()), pa.array(part), pa.array(kind), pa.array(ids[start]), pa.array(ids[stop - 1]), pa.array(stop - start), packed(ids, start)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LISTS.split(", ")])


def merged(rows: DataFrame, marks: list[int], by: list[str]) -> DataFrame:
    """The blocks of LISTS, in which kind 0 is a block that is there, 1 are ids to put in, -1 ids to take out.

    An id goes into the last block of its token that begins at it or before it, and into one of its own if there is none;
    blocks into which none goes stay as they are. A task takes whole tokens, MERGED ids or so at a time; of a token with
    more, a range of ids after the other, and what blocks reach into the next range is kept back for it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ends, low = np.cumsum(batch.column(5).to_numpy()), 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MERGED, "right")))
                part = batch.slice(low, high - low)
                low = high
                rows = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()[0]
                begin = int(np.searchsorted(pc.equal(rows.column(0), rows.column(0)[-1]).to_numpy(zero_copy_only=False), True))
                if begin:
                    yield shown(changed(rows.slice(0, begin)))
                held = rows.slice(begin)
                if pc.sum(held.column(5)).as_py() > MERGED and held.column(1)[0] != held.column(1)[-1]:
                    last = held.column(1)[-1].as_py()
                    cut_at = int(np.searchsorted(held.column(1).to_numpy(), last))
                    out = changed(held.slice(0, cut_at))
                    open_ = out.column(4).to_numpy() >= marks[last - 1]
                    yield shown(out.filter(pa.array(~open_)))
                    kept = out.filter(pa.array(open_)).set_column(1, "part", pa.array(np.full(int(open_.sum()), last)))
                    held = pa.Table.from_batches([kept, held.slice(cut_at)]).combine_chunks().to_batches()[0]
        if held is not None and held.num_rows:
            yield shown(changed(held))

    def shown(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.select([c.split()[0] for c in BLOCKS.split(", ")])

    def changed(rows: pa.RecordBatch) -> pa.RecordBatch:
        """rows (whole tokens) as blocks, in the order of (token, first) but for those that stay."""
        words = rows.column(0).dictionary_encode()
        code, kind, first = words.indices.to_numpy().astype(np.int64), rows.column(2).to_numpy(), rows.column(3).to_numpy()
        old, new = np.flatnonzero(kind == 0), np.flatnonzero(kind)
        ids, size = unpacked(first[new], rows.column(6).take(pa.array(new)))
        token, op = np.repeat(code[new], size), np.repeat(kind[new], size).astype(np.int64)
        block, touched = np.full(len(ids), -1), np.zeros(0, np.int64)
        if len(old):
            both = np.concatenate((code[old], token)), np.concatenate((first[old], ids))
            order = ordered(*both)  # of equal ones the blocks first
            before = np.maximum.accumulate(np.where(order < len(old), np.arange(len(order)), -1))
            found = np.where(before < 0, -1, order[before])
            found[(found >= 0) & (both[0][found] != both[0][order])] = -1
            placed = np.empty(len(order), np.int64)
            placed[order] = found
            block = placed[len(old) :]
            touched = np.unique(block[block >= 0])
            there, n = unpacked(first[old[touched]], rows.column(6).take(pa.array(old[touched])))
            ids, token = np.concatenate((ids, there)), np.concatenate((token, np.repeat(code[old[touched]], n)))
            op, block = np.concatenate((op, np.zeros(len(there), np.int64))), np.concatenate((block, np.repeat(touched, n)))
        stays = rows.take(pa.array(np.setdiff1d(old, old[touched])))
        if not len(ids):
            return stays
        order = ordered(token, ids)
        ids, token, op, block = ids[order], token[order], op[order], block[order]
        begin = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (token[1:] != token[:-1]))))
        keep = begin[(np.maximum.reduceat(op, begin) == 1) | (np.minimum.reduceat(op, begin) == 0)]
        if not len(keep):
            return stays
        ids, token, block = ids[keep], token[keep], block[keep]
        # a new block ends with its range of ids, as the next range of the token may be another task's
        part = np.where(block < 0, np.searchsorted(marks, ids, "right"), 0)
        run = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1]))))
        start = np.flatnonzero((np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids))))) % BLOCK == 0)
        made = rows_of(words.dictionary.take(pa.array(token[start])), np.zeros(len(start), np.int64), np.zeros(len(start), np.int32), ids, start, np.append(start[1:], len(ids)))
        return pa.Table.from_batches([made, *([stays.cast(made.schema)] if stays.num_rows else [])]).combine_chunks().to_batches()[0]

    return rows.repartition(*by).sortWithinPartitions("token", "part").mapInArrow(work, BLOCKS)


def build(leaves: DataFrame) -> DataFrame:
    """The index of leaves (leaf_id, tokens), in a checkpoint, as where blocks end depends on the ranges; null ids and repeated tokens of a leaf are left out."""
    marks = marks_of(leaves)
    return cut(merged(lists(leaves.withColumn("op", F.lit(1)), marks), marks, ["token", "part"]))


def placed_ids(index: DataFrame) -> DataFrame:
    """(token, leaf_id, block) of all blocks; block is where the id's block begins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [decoded(a, b) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                row = pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(np.concatenate(ids)), part.column(1).take(row)], ["token", "leaf_id", "block"])

    return index.select("token", "first", "ids").mapInArrow(work, "token string, leaf_id long, block long")


def postings(index: DataFrame) -> DataFrame:
    """(token, leaf_id) of all blocks."""
    return placed_ids(index).select("token", "leaf_id")


def _placed(index: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (token, leaf_id, names) with `block`, the beginning of the last block of the token that begins at the id or before it; null if there is none."""
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    both = index.select("token", F.col("first").alias("leaf_id"), *nothing, F.col("first"), F.lit(0).alias("side")).unionByName(rows.select("token", "leaf_id", *names, F.lit(None).cast("long").alias("first"), F.lit(1).alias("side")))
    return numbered(both, ["token"], ["leaf_id", "side"], "place", filled={"block": "first"}).where("side = 1").select("token", "leaf_id", *names, "block")


def update(index: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The index after leaves were taken out and others put in, both (leaf_id, tokens): a leaf that has changed is in removed as it was, and in added as it is.

    Only blocks that a change falls into are written anew; the others stay as they are. If few tokens change, the blocks of the others aren't shuffled."""
    change = removed.select("leaf_id", "tokens", F.lit(-1).alias("op")).unionByName(added.select("leaf_id", "tokens", F.lit(1).alias("op")))
    marks = marks_of(change)
    own = cut(lists(change, marks))
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    tokens = own.select("token").distinct()
    some, rest = index, None
    if own.count() <= FEW or tokens.count() <= FEW:
        some, rest = (index.join(F.broadcast(tokens), "token", how) for how in ("left_semi", "left_anti"))
    part = F.size(F.filter(F.lit(marks), lambda m: m <= F.col("first"))) if marks else F.lit(0)
    old = some.select("token", part.cast("long").alias("part"), F.lit(0).alias("kind"), *names[1:])
    now = merged(old.unionByName(own), marks, ["token"])
    return cut(now if rest is None else now.unionByName(rest.select(*names)))


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, leaf_id) of the leaves that have all of a query's tokens (query_id, tokens); a query without tokens finds nothing.

    The ids of a query's rarest token are looked up in the lists of its other tokens; of these only the blocks in which
    such an id can be are read. The queries' tokens should be few enough to be broadcast; the index isn't shuffled for them."""
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"), F.size(F.array_distinct("tokens")).alias("need"))
    wanted = cut(index.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi"))  # the parts of the index that are asked for
    sizes = wanted.groupBy("token").agg(F.sum("n").alias("n"))
    known = asked.join(sizes, "token")
    rare = known.groupBy("query_id", "need").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count("*").alias("have")).where("have = need")
    rare = cut(rare)
    start = postings(wanted.join(rare.select("token").distinct(), "token", "left_semi")).join(rare.select("query_id", "token", "need"), "token")
    start = cut(start.select("query_id", "leaf_id", "need", F.col("token").alias("rarest")))
    probes = start.join(asked.select("query_id", "token"), "query_id").where("token <> rarest").select("token", "leaf_id").distinct()
    placed = _placed(wanted, probes, []).where("block is not null").groupBy("token", "block").agg(F.collect_list("leaf_id").alias("sought"))
    met = wanted.join(placed, (wanted["token"] == placed["token"]) & (F.col("first") == F.col("block"))).select(wanted["token"], "first", "ids", "sought")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, first, ids, sought in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.intersect1d(decoded(first, ids), np.array(sought, np.int64))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([token] * len(found)), pa.array(found)], ["token", "leaf_id"])

    found = met.mapInArrow(work, "token string, leaf_id long")
    held = start.join(asked.select("query_id", "token"), "query_id").where("token <> rarest").join(found, ["token", "leaf_id"])
    counted = held.groupBy("query_id", "leaf_id", "need").agg(F.count("*").alias("have")).where("have = need - 1").select("query_id", "leaf_id")
    return counted.unionByName(start.where("need = 1").select("query_id", "leaf_id"))


def save(index: DataFrame, path: str) -> None:
    """Writes the blocks as Parquet files in ranges of tokens, so that a filter on tokens reads only their row groups."""
    index.repartitionByRange("token", "first").sortWithinPartitions("token", "first").write.mode("overwrite").parquet(path)
