"""Hierarchical packing of token sequences into windows of several lengths (operator 7).

A document longer than the largest window is cut into full windows and a rest; every rest is routed to the smallest
tier that holds it. A tier's window begins with its longest piece; gaps are filled from the same and the shorter tiers,
by a piece or two that fill them exactly wherever there are such, and only else by cutting one piece. So windows are
full and most documents whole. Only the last pieces of a task can be left without a full window; these are cut down to
powers of two, which need no padding. The windows of a lot are then dealt to step groups of balanced token counts, each
with a like share of every tier."""

from __future__ import annotations

import heapq
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Words, equal, slices, unlike

TIERS = (512, 1024, 2048, 4096)
#: Documents that are packed together; a task packs one lot after another.
LOT_TOKENS = 1 << 20
#: Tokens that are left for the next lot, so that there are always pieces to choose from.
RESERVE = 1 << 17
#: Distinct words whose ids a worker keeps.
KEPT = 1_500_000
#: Bytes of words after which they are forgotten.
KEPT_BYTES = 1 << 25
ENDS = np.isin(np.arange(256), [10, 32])
#: 1: letters, 2: digits, 3: marks but for the apostrophe and control characters, 0: any other.
ASCII_KINDS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 32 < b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.int8)


def kinds(data: np.ndarray) -> np.ndarray:
    """Kinds of UTF-8 bytes; U+00C0 to U+00FF but for the two marks among them are letters like those of ASCII."""
    out = ASCII_KINDS[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    out[at] = out[at + 1] = 1
    return out


Piece = tuple[int, int, int]  # document's place in the lot, start, length


class Encoder:
    """Token ids of whole texts.

    In this vocabulary space and line feed end a word, and so does a change between ASCII letters, digits and marks
    (without the apostrophe), of ASCII or Latin; case is dropped. So each part between such places is encoded once and
    kept by its hash, with its bytes: parts are compared byte by byte, and a slice in which two parts share a hash is
    encoded text by text. So are texts that hold a special token's string in any case: as the tokenizer has it, that is
    one id, unless special is false, when it is text like any other."""

    def __init__(self, path: str, stop: int, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have a core each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.stop = stop
        self._clear()

    def _clear(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and each one's place in the tables
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.from_, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and all ids."""
        found: list[list[int]] = []
        for low in range(0, len(parts), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(parts[low : low + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))

    def _add(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """hashes: sorted, not known yet."""
        size, ids = self._ids([p.decode() for p in parts])
        at = np.searchsorted(self.hash, hashes)
        self.place = np.insert(self.place, at, len(self.begins) - 1 + np.arange(len(parts)))
        self.hash = np.insert(self.hash, at, hashes)
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(size)))
        self.ids = np.concatenate((self.ids, ids))
        self.from_ = np.concatenate((self.from_, self.from_[-1] + np.cumsum([len(p) for p in parts], dtype=np.int64)))
        self.data = np.concatenate((self.data, np.frombuffer(b"".join(parts), np.uint8)))

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        size, ids = self._ids([t or "" for t in texts.to_pylist()])
        return [np.append(x, np.uint32(self.stop)) for x in np.split(ids, np.cumsum(size)[:-1])]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        odd = self._marked(texts)
        if not odd.any():
            return self._by_parts(texts) if len(texts) else []
        plain = iter(self._plain(texts.filter(pa.array(odd))))
        rest = iter(self._by_parts(texts.filter(pa.array(~odd))) if not odd.all() else [])
        return [next(plain if x else rest) for x in odd]

    def _marked(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a special token's string in any case. Few have even its beginning that isn't letters, which is found faster."""
        out = np.zeros(len(texts), bool)
        for mark in self.special:
            begin = "".join(takewhile(lambda c: not c.isalpha(), mark))
            some = np.flatnonzero(pc.fill_null(pc.match_substring(texts, begin), False).to_numpy(zero_copy_only=False))
            out[some] |= pc.match_substring(texts.take(pa.array(some)), mark, ignore_case=True).to_numpy(zero_copy_only=False)
        return out

    def _by_parts(self, texts: pa.Array) -> list[np.ndarray]:
        w = Words(texts, split=ENDS, kinds=kinds)
        size = w.stops - w.starts
        unique, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if (size != size[first][back]).any() or not equal(w.data, w.starts, w.data, w.starts[first][back], size).all():
            return self._plain(texts)
        for retry in (False, True):
            at = np.minimum(np.searchsorted(self.hash, unique), max(len(self.hash) - 1, 0))
            new = self.hash[at] != unique if len(self.hash) else np.ones(len(unique), bool)
            if not retry and (len(self.hash) + new.sum() > KEPT or len(self.data) > KEPT_BYTES):
                self._clear()
                continue
            break
        old, own = self.place[at[~new]] if len(self.hash) else self.place, first[~new]
        kept = self.from_[old + 1] - self.from_[old]
        if (kept != size[own]).any() or not equal(self.data, self.from_[old], w.data, w.starts[own], kept).all():
            return self._plain(texts)
        if new.any():
            data = w.data.tobytes()
            self._add(unique[new], [data[a:b] for a, b in zip(w.starts[first[new]], w.stops[first[new]])])
        place = self.place[np.searchsorted(self.hash, unique)][back]
        size = self.begins[place + 1] - self.begins[place]
        from_, size = np.insert(self.begins[place], w.first[1:], 0), np.insert(size, w.first[1:], 1)
        to = np.cumsum(size)
        ids = self.ids if len(self.ids) else np.zeros(1, np.uint32)
        out = ids[np.arange(to[-1]) + np.repeat(from_ - (to - size), size)]
        ends = to[w.first[1:] + np.arange(w.n_docs)]
        out[ends - 1] = self.stop
        return np.split(out, ends[:-1])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, reserve: int = 0) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces) for documents of these lengths, and the pieces left: once they have `reserve` tokens or fewer, or fill no window."""
    top = tiers[-1]
    done: list[tuple[int, list[Piece]]] = []
    pool: dict[int, list[Piece]] = defaultdict(list)
    have = np.zeros(top + 1, np.int64)  # pieces of each length
    total = 0

    def put(p: Piece) -> None:
        pool[p[2]].append(p)
        have[p[2]] += 1

    def take(n: int) -> Piece:
        have[n] -= 1
        return pool[n].pop()

    for d, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            done.append((top, [(d, at, top)]))
            at += top
        if n > at:
            put((d, at, n - at))
            total += n - at
    longest = top
    while total > reserve:
        while not have[longest]:
            longest -= 1
        tier = next(t for t in tiers if t >= longest)
        if total < tier:
            break
        window = [take(longest)]
        room = tier - longest
        while room:
            if have[room]:
                window.append(take(room))
                break
            some = np.flatnonzero(have[:room])
            if not len(some):
                break
            mate = room - some
            two = some[have[mate] > (mate == some)]  # two pieces that fill the room exactly
            n = int(two[-1]) if len(two) else int(some[-1])
            window.append(take(n))
            room -= n
            if len(two):
                window.append(take(room))
                break
        gap = tier - sum(p[2] for p in window)
        if gap:  # nothing fits: one piece is cut, the longest
            n = int(np.flatnonzero(have)[-1])
            d, at, _ = take(n)
            window.append((d, at, gap))
            put((d, at + gap, n - gap))
        done.append((tier, window))
        total -= tier
    return done, [p for n in sorted(pool, reverse=True) for p in pool[n]]


def steps(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> tuple[np.ndarray, int]:
    """Each window's step group, and how many groups: about step_tokens each, dealt from the largest windows to the smallest, always to the group that has least so far. So groups differ by one window at most, and have like shares of every tier."""
    size = np.array([t for t, _ in windows], np.int64)
    groups = max(1, round(int(size.sum()) / step_tokens))
    load = [(0, g) for g in range(groups)]
    out = np.zeros(len(windows), np.int64)
    for i in np.argsort(-size, kind="stable").tolist():
        least, g = load[0]
        out[i] = g
        heapq.heapreplace(load, (least + int(size[i]), g))
    return out, groups


def fill(pieces: list[Piece], tier: int) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Cuts pieces, one after another, into full windows of a tier."""
    done, window, room = [], [], tier
    for d, at, n in pieces:
        while n:
            k = min(n, room)
            window.append((d, at, k))
            at, n, room = at + k, n - k, room - k
            if not room:
                done.append((tier, window))
                window, room = [], tier
    return done, window


def last(pieces: list[Piece], top: int) -> list[tuple[int, list[Piece]]]:
    """Windows of powers of two that hold the pieces exactly."""
    done, size = [], top
    while pieces:
        total = sum(p[2] for p in pieces)
        size = min(size, 1 << (total.bit_length() - 1))
        full, rest = fill(pieces, size)
        done += full
        pieces = rest
    return done


def sequences(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", stop: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 15, special: bool = True) -> DataFrame:
    """One row for every piece of a document in a sequence: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step.

    vocabulary: path of the tokenizer's file; special: whether the strings of its special tokens stand for these, as in
    the tokenizer's plain call, or are text. Null and empty texts are the stop id alone; repeated rows are packed
    each; the key may be null. Every task packs the rows of its own partition, lot after lot, without a shuffle and in
    their order, so a task that runs again packs alike; what a lot leaves open goes into the next. sequence_id has the
    partition's number above its lower 40 bits. step numbers groups of sequences of about step_tokens tokens, balanced
    over the windows and tiers of a lot; a task's last group may have fewer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = Encoder(vocabulary, stop, special), TaskContext.get().partitionId() << 40
        made, stepped = 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        begun: list[int] = []  # tokens of each held document that are placed already, for those carried over
        whole: list[int] = []

        def rows(windows: list[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal made, stepped
            out: list[tuple] = []
            group, groups = steps(windows, step_tokens)
            for (tier, window), g in zip(windows, group.tolist()):
                offset = 0
                for d, at, n in window:
                    crc = zlib.crc32(ids[d][at : at + n].tobytes())
                    out.append((keys[d], begun[d] + at, n, crc, whole[d], base + made, offset, tier, (base >> 20) + stepped + g))
                    offset += n
                made += 1
            stepped += groups
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind_arrow), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        def carry(left: list[Piece]) -> None:
            nonlocal keys, ids, begun, whole
            keys, begun, whole, ids = [keys[d] for d, _, _ in left], [begun[d] + at for d, at, _ in left], [whole[d] for d, _, _ in left], [ids[d][at : at + n] for d, at, n in left]

        kind_arrow = None
        for part in slices(batches, text, 1 << 20):
            kind_arrow = part.schema.field(0).type
            new = encode(part.column(1))
            keys += part.column(0).to_pylist()
            ids += new
            begun += [0] * len(new)
            whole += [len(x) for x in new]
            if sum(map(len, ids)) >= LOT_TOKENS:
                done, left = pack([len(x) for x in ids], tiers, RESERVE)
                yield from rows(done)
                carry(left)
        if ids:
            done, left = pack([len(x) for x in ids], tiers)
            yield from rows(done + last(left, tiers[-1]))

    unlike(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, ", ".join([f"`{key}` {kind}", *(f"`{n}` long" for n in names[1:])]))
