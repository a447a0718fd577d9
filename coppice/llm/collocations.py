"""Phrase collocations: exact counts of word n-grams, hash bucket by hash bucket (operator 12).

Texts are cut into pieces at punctuation, and equal pieces of a language become one row with their number. Then one
pass for each length n: a task takes a lot of pieces, numbers the lot's words exactly and an n-gram by the pair of
numbers of its two overlapping (n-1)-grams, sums the pieces' numbers, and sends each different n-gram on once. All rows
of a hash bucket meet in one task, where duckdb sums them, on disk if they don't fit into memory; those of the least
count or more stay. As no n-gram is more frequent than its parts, a pass leaves out what holds an (n-1)-gram that the
pass before didn't keep. Which ones it kept stands in a bit map of their hashes of bounded size: where two hashes fall
on one bit, or the map is full, more is counted than need be, and the counts are the same.

The counts of a candidate's parts lie in other buckets: each cut asks for its two parts by a shuffled request, and the
answers meet at the candidate."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup
from .common import ascii_lower, bit_map, cut, hashed, mixed

#: Bytes of pieces whose n-grams a task sums before it sends them on.
HELD = 12 << 20
#: Memory of the count of a hash bucket; what is beyond it goes to the task's scratch folder.
MEMORY = "256MB"
#: Bytes of text for each hash bucket.
BUCKET_BYTES = 32 << 20
#: Groups into which a language's candidates are dealt to find each group's best first.
SALTS = 64
GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("times", pa.int64())])


def pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, piece, words, times): the different pieces of each language, words separated by one space, and how often each occurs."""
    each = F.explode(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "[.,;:!?\\x0A-\\x0D]"))
    cut_up = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), each.alias("raw"))
    named = cut_up.select("lang", F.regexp_replace(F.btrim("raw", F.lit(" \t")), "[ \\t]+", " ").alias("piece")).where("piece <> ''")
    return named.groupBy("lang", "piece").agg(F.count("*").alias("times")).withColumn("words", F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)


def _numbered(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, int]:
    """Consecutive numbers of the different pairs (a, b), b < n_b, and how many there are."""
    key = a.astype(np.int64) * n_b + b
    if not len(key):
        return key, 0
    top = int(key.max()) + 1
    if top <= 8 * len(key):
        there = np.zeros(top, bool)
        there[key] = True
        number = np.cumsum(there) - 1
        return number[key], int(number[-1]) + 1
    own, number = np.unique(key, return_inverse=True)
    return number, len(own)


def phrase_hash(langs: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of phrases, given by their bytes and the hashes of their languages."""
    with np.errstate(over="ignore"):
        return mixed(hashed(data, starts, stops) + langs * np.uint64(0xD6E8FEB86659FD93))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes and where each begins (and the last ends)."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _lang_hash(langs: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The languages by number, and the hash of each number."""
    coded = langs.dictionary_encode()
    data, at = _bytes(coded.dictionary)
    return coded, hashed(data, at[:-1], at[1:])


class Lot:
    """All words of some pieces, with an exact number for each (language, word)."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        langs = rows.column("lang").combine_chunks()
        self.langs, self.lang_hash = _lang_hash(langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs)
        piece = rows.column("piece").combine_chunks()
        data, offsets = _bytes(piece.chunk(0) if isinstance(piece, pa.ChunkedArray) else piece)
        self.data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        spaces = np.flatnonzero(self.data == 32)
        self.starts = np.sort(np.concatenate((offsets[:-1], spaces + 1)))
        self.stops = np.sort(np.concatenate((offsets[1:], spaces)))
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        ends = np.concatenate(([0], np.cumsum(self.stops - self.starts)))
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[self.data != 32]))]).dictionary_encode()
        self.lang = self.langs.indices.to_numpy()[self.row]
        self.first, self.kinds = _numbered(self.lang, words.indices.to_numpy(), max(1, len(words.dictionary)))
        self.times = rows.column("times").to_numpy()[self.row]

    def grams(self, n: int, kept: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        """A place of each different n-gram all of whose parts may have been kept, and how often it occurs."""
        at, number, kinds = np.arange(len(self.first)), self.first, self.kinds
        for size in range(2, n + 1):
            may = self._kept(at, number, kinds, size - 1, *kept[size - 2])[number]
            at, number = at[may], number[may]
            follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (self.row[np.minimum(at[:-1] + size - 1, len(self.row) - 1)] == self.row[at[:-1]]) & (at[:-1] + size - 1 < len(self.row)))
            at, (number, kinds) = at[follows], _numbered(number[follows], number[follows + 1], max(1, kinds))
        place = np.zeros(kinds, np.int64)
        place[number] = at
        times = np.zeros(kinds, np.int64)
        np.add.at(times, number, self.times[at])
        return place, times

    def _kept(self, at: np.ndarray, number: np.ndarray, kinds: int, size: int, bits: np.ndarray, log: int) -> np.ndarray:
        """For each numbered n-gram of `size` words, whether the map has its bit."""
        place = np.zeros(kinds, np.int64)
        place[number] = at
        h = self.hash(place, size)
        spot = h >> np.uint64(64 - log)
        return (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def hash(self, place: np.ndarray, size: int) -> np.ndarray:
        return phrase_hash(self.lang_hash[self.lang[place]], self.data, self.starts[place], self.stops[place + size - 1])

    def batch(self, place: np.ndarray, times: np.ndarray, size: int) -> pa.RecordBatch:
        """The n-grams as rows."""
        begin, length = self.starts[place], self.stops[place + size - 1] - self.starts[place]
        ends = np.concatenate(([0], np.cumsum(length)))
        index = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
        phrases = pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.data[index])])
        return pa.RecordBatch.from_arrays([self.langs.dictionary.take(pa.array(self.lang[place])).cast(pa.string()), phrases, pa.array(times)], schema=GRAMS)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Lot]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size >= HELD:
            yield Lot(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield Lot(pa.Table.from_batches(held))


def counts(parts: DataFrame, n: int, least: int, kept: list[tuple[Broadcast, int]], buckets: int) -> DataFrame:
    """(lang, phrase, times) of all n-grams that occur `least` times or more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [(bits.value, log) for bits, log in kept]
        for lot in _lots(batches):
            place, times = lot.grams(n, maps)
            for low in range(0, len(place), 1 << 16):
                yield lot.batch(place[low : low + (1 << 16)], times[low : low + (1 << 16)], n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch}) as db:
            grams = pa.RecordBatchReader.from_batches(GRAMS, (pa.RecordBatch.from_arrays(b.columns, schema=GRAMS) for b in batches))  # noqa: F841
            found = db.sql(f"SELECT lang, phrase, sum(times)::BIGINT AS times FROM grams GROUP BY lang, phrase HAVING sum(times) >= {int(least)}")
            yield from found.to_arrow_reader(1 << 14)

    kind = "lang string, phrase string, times long"
    return cut(parts.select("lang", "piece", "times").mapInArrow(gather, kind).repartition(buckets, "lang", "phrase").mapInArrow(count, kind))


def hashes(found: DataFrame) -> DataFrame:
    """(h) of the phrases (lang, phrase, ...)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, lang_hash = _lang_hash(batch.column(0))
            data, at = _bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(lang_hash[coded.indices.to_numpy()], data, at[:-1], at[1:]).view(np.int64))], ["h"])

    return found.select("lang", "phrase").mapInArrow(work, "h long")


def frequent(parts: DataFrame, least: int, longest: int, buckets: int) -> list[DataFrame]:
    """(lang, phrase, times) of the n-grams of each length, from 1 on, as long as there are any."""
    out, kept = [], []
    for n in range(1, longest + 1):
        out.append(counts(parts, n, least, kept, buckets))
        if n < longest:
            bits = bit_map(hashes(out[-1]))
            if bits is None:
                break
            kept.append((parts.sparkSession.sparkContext.broadcast(bits[0]), bits[1]))
    return out


def _within(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def answered(requests: DataFrame, found: DataFrame, asks: str, answer: str) -> DataFrame:
    """requests with the count of the n-gram (lang, asks), by a shuffle of requests in which no n-gram that many ask for stands in one task."""
    key = F.struct("lang", F.col(asks).alias("phrase"))
    asked = requests.groupBy(key.alias("of")).agg(F.count("*").alias("n"))
    known = found.select(F.struct("lang", "phrase").alias("part"), F.col("times").alias(answer))
    label = cut(asked.join(known, F.col("of") == F.col("part"), "left").select("of", "n", answer))
    return lookup(requests.withColumn("_key", key), "_key", label, "of", "n").drop("_key", "of", "n", asks)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, share: int = 100, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `best` phrases of each language by score, a (their count) and bytes.

    Phrases of 2 to `longest` words that occur `least` times or more are candidates. A cut after k words scores
    floor(1000 a n / (l r)), where l and r count both parts and n all words of the language; the lowest cut counts, the
    first of equal ones. Candidates within a longer candidate of `share` hundredths of their count or more are dropped:
    it is enough to look at those of one word more, as the ones between are at least as frequent as the longer one.
    A null text is empty, a null language is `und`; a row counts as often as it is repeated. Texts without words give no
    pieces, and without candidates there are no rows. Products are decimals of 38 digits. Other columns don't matter."""
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] // BUCKET_BYTES))
    parts = cut(pieces(docs, text, lang))
    sizes = parts.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n"))
    found = frequent(parts, least, longest, buckets)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    words = F.split("phrase", " ")
    longer = every.select("lang", "phrase", "times", F.size(words).alias("size")).where("size > 1")
    # parts of one word less: of the longest of them what is dropped if it is no more frequent
    inner = longer.where("size > 2").select("lang", F.explode(F.array(_within(words, F.lit(1), F.col("size") - 1), _within(words, F.lit(2), F.col("size") - 1))).alias("inner"), "times")
    most = inner.groupBy("lang", "inner").agg(F.max("times").alias("most")).select(F.col("lang").alias("_lang"), "inner", "most")
    left = longer.join(most, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("inner")), "left").where(F.coalesce(100 * F.col("most") < share * F.col("times"), F.lit(True)))
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), _within(words, F.lit(1), k).alias("head"), _within(words, k + 1, F.col("size") - k).alias("tail"))))
    requests = left.select("lang", "phrase", F.col("times").alias("a"), cuts.alias("x")).select("lang", "phrase", "a", "x.*")
    told = answered(answered(cut(requests), every, "head", "l"), every, "tail", "r")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    shown = cut(lookup(told, "lang", cut(sizes.join(told.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("m")), F.col("lang") == F.col("_lang")).select(F.col("lang").alias("of"), "n", "m")), "of", "m").drop("of", "m"))
    scored = shown.withColumn("_ratio", F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(16,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct(F.col("_ratio").alias("score"), "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*").drop("k")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = least_cut.withColumn("_salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))).where(F.col("_r") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
