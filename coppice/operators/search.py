"""Hybrid search of many queries in one plan: literal or regex matches first, then trigram-fuzzy ones, preferred roots first.

leaves: leaf_id, file, branch, line, text. queries: query_id, query, and optionally files (array of preferred files).

Exact matches of a block of queries are found in one pass over the texts, by one automaton of all needles; for a regex
the needle is the longest literal that every match must contain, and what holds it is verified by the regex. Ranking
works on ids; texts are joined to the final rows only."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .needles import automaton, met as held

META = re.compile(r"[.*+?^${}()|\[\]\\]")
#: Queries that are searched for together; more are taken in further blocks over all leaves.
QUERIES = 2000
#: Distinct tokens of queries that are compared with the words of the leaves together; more are taken in further blocks.
TOKENS = 1 << 13
#: Words of leaves whose similar query tokens a task remembers.
KNOWN = 1 << 18
#: Final rows that are broadcast to fetch their texts at most.
FEW = 1 << 17
#: Words of leaves whose common grams with the queries' tokens are counted together.
AT_ONCE = 2048
#: Grams of a word that are looked up in what its others have found, and not the other way round, at most.
SPARE = 4
#: Leaves that are scored together.
LEAVES = 512
#: A query token that finds nothing this similar in a leaf rules the leaf out.
FLOOR = 0.4
#: Bytes of texts that a task takes up at a time.
SLICE_BYTES = 2 << 20
#: Characters that a regex's literal must have to narrow its texts down.
RUN = 3


def java_pattern(spark: SparkSession, query: str, case_sensitive: bool = False) -> str:
    """The query as a regex for Spark, which runs the JVM's; one that the JVM doesn't compile is taken literally. Case is folded as Unicode has it."""
    flags = "" if case_sensitive else "(?iu)"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(flags + query)
    except IllegalArgumentException:
        query = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query)
    return flags + query


class _Alike(dict):
    """Of a character's code the one that stands for it where case doesn't count, by single characters as in the JVM."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        low = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = ord(low) if len(low) == 1 else ord("i") if code == 0x130 else code
        return self[code]


ALIKE = _Alike()


def alike(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ALIKE)


def literal(pattern: str) -> str:
    """The longest run of characters that every match of the regex contains one after another; empty if none is certain, as for syntax that only the JVM has."""
    if re.search(r"\(\?[a-z]*[uUdx]", pattern.removeprefix("(?iu)")):
        return ""
    try:
        parsed = parser.parse(pattern.removeprefix("(?iu)"))
    except (re.error, RecursionError, OverflowError):
        return ""
    runs = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            runs[-1] += chr(arg)
        else:
            runs.append("")
    return max(runs, key=len)


def _exact(leaves: DataFrame, queries: DataFrame, mode: str, case_sensitive: bool) -> DataFrame:
    """(query_id, leaf_id, file, line, preferred) of exact matches. queries: a block of QUERIES at most."""
    spark = leaves.sparkSession
    asked = queries.select("query_id", "query", "files", T.fold(T.compatible(F.col("query")), case_sensitive).alias("needle")).collect()  # QUERIES at most
    is_regex = [mode == "regex" or mode == "auto" and bool(META.search(r.query)) for r in asked]
    patterns = [java_pattern(spark, r.query, case_sensitive) if x else None for r, x in zip(asked, is_regex)]
    runs = [literal(p) if p else "" for p in patterns]
    plain = [(q, r.needle) for q, r in enumerate(asked) if not is_regex[q]]
    narrowed = [(q, run if case_sensitive else alike(run)) for q, run in enumerate(runs) if len(run) >= RUN]
    free = [q for q, p in enumerate(patterns) if p and len(runs[q]) < RUN]
    kind = queries.schema["query_id"].dataType
    table = spark.createDataFrame([(q, r.query_id, patterns[q], r.files) for q, r in enumerate(asked)], f"q int, query_id {kind.simpleString()}, pattern string, files array<string>")
    share = spark.sparkContext.broadcast((plain, narrowed))
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [automaton(needles) for needles in share.value]
        for batch in parts(batches):
            rows, qs, texts = [], [], []
            for i, (folded, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                for q in held(found[0], folded):
                    rows.append(i), qs.append(q), texts.append(None)
                for q in held(found[1], alike(text) if text and not case_sensitive else text):
                    rows.append(i), qs.append(q), texts.append(text)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), *(batch.column(c).take(at) for c in range(3)), pa.array(texts, pa.string())], ["q", "leaf_id", "file", "line", "text"])

    folded = T.fold(T.compatible(F.col("text")), case_sensitive) if plain else F.lit(None).cast("string")
    own = leaves.select("leaf_id", "file", "line", folded.alias("folded"), (F.col("text") if narrowed else F.lit(None).cast("string")).alias("text"))
    got = own.mapInArrow(work, f"q int, leaf_id {kinds['leaf_id']}, file string, line {kinds['line']}, text string")
    met = got.join(F.broadcast(table), "q").where("text is null or text rlike pattern")
    if free:  # nothing that they must contain is known: these are held against every text
        every = leaves.join(F.broadcast(table.where(F.col("q").isin(free))), F.expr("text rlike pattern"))
        met = met.select("query_id", "leaf_id", "file", "line", "files").unionByName(every.select("query_id", "leaf_id", "file", "line", "files"))
    return met.select("query_id", "leaf_id", "file", "line", F.coalesce(F.array_contains("files", F.col("file")), F.lit(False)).alias("preferred"))


def parts(batches: Iterator[pa.RecordBatch], texts: tuple[int, ...] = (3, 4)) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about SLICE_BYTES of texts at most, or a single row, so that few texts at a time are Python's."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        ends, low = np.cumsum(size), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high


def grams(token: str) -> set[str]:
    """`functions.text.trigrams` of one token."""
    padded = f"  {token} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def gram_keys(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the token, key of the gram) of all distinct `grams` of the tokens, by token; a key is a gram's three characters, 21 bits each."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 3
    code = np.frombuffer("".join(f"  {t} " for t in tokens).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(tokens)), size)
    at = np.flatnonzero(of[2:] == of[:-2])
    of, key = of[at], code[at] << 42 | code[at + 1] << 21 | code[at + 2]
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]))[: len(of)]
    return of[new], key[new]


class GramIndex:
    """Postings of the grams of some tokens, by which the tokens similar to others are counted."""

    def __init__(self, tokens: list[str]):
        of, key = gram_keys(tokens)
        order = np.argsort(key, kind="stable")
        self.postings = of[order].astype(np.int32 if AT_ONCE * len(tokens) < 1 << 31 else np.int64)
        self.keys, start = np.unique(key[order], return_index=True)
        self.offsets = np.append(start, len(key))
        self.sizes = np.bincount(of, minlength=len(tokens)).astype(float)
        # a bit for each token and gram
        self.spare = SPARE if len(tokens) * len(self.keys) < 1 << 30 else 0
        self.has = np.zeros((len(tokens), len(self.keys) // 8 + 1) if self.spare else (0, 0), np.uint8)
        if self.spare:
            g = np.searchsorted(self.keys, key)
            np.bitwise_or.at(self.has, (of, g >> 3), (1 << (g & 7)).astype(np.uint8))

    def similar(self, tokens: list[str], floor: float) -> Iterator[tuple]:
        """(number in tokens, number in the index, similarity) of all that are as similar as floor or more, for parts of tokens at a time."""
        most = len(self.sizes)
        for low in range(0, len(tokens) if most else 0, AT_ONCE):
            own = tokens[low : low + AT_ONCE]
            of, key = gram_keys(own)
            size = np.bincount(of, minlength=len(own))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[at] == key
            of, at = of[met], at[met]
            # a token too few of whose grams are there for the shortest in the index is similar to none
            hits = np.bincount(of, minlength=len(own))
            may = (2.0 * hits >= (floor - 1e-9) * (size + self.sizes.min()))[of]
            of, at = of[may], at[may]
            # what is similar shares so many grams that it meets one of the rarer ones; the `spare` most frequent are asked for candidates only
            length = self.offsets[at + 1] - self.offsets[at]
            order = np.lexsort((-length, of))
            of, at, length = of[order], at[order], length[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            spare = np.minimum(np.maximum(np.ceil((floor / 2 - 1e-9) * (size + self.sizes.min())).astype(np.int64) - 1, 0), self.spare)
            asked = place < spare[of]
            later = np.full((len(own), self.spare), len(self.keys))  # a gram that no token has
            later[of[asked], place[asked]] = at[asked]
            of, at, length = of[~asked], at[~asked], length[~asked]
            where = np.repeat(self.offsets[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
            pair = np.sort(np.repeat((of * most).astype(self.postings.dtype), length) + self.postings[where])
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            i, k, common = pair[first] // most, pair[first] % most, np.diff(np.append(first, len(pair)))
            near = 2.0 * (common + spare[i]) >= (floor - 1e-9) * (size[i] + self.sizes[k])
            i, k, common = i[near].astype(np.int64), k[near].astype(np.int64), common[near]
            for n in range(self.spare):
                g = later[i, n]
                common += self.has[k, g >> 3] >> (g & 7).astype(np.uint8) & 1
            value = 2.0 * common / (size[i] + self.sizes[k])
            some = value >= floor
            yield i[some] + low, k[some], value[some]


def similar_tokens(words: DataFrame, asked: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(q, token, similarity) of all distinct tokens of words (token) whose trigram similarity to one of asked (q) is floor or more.

    A stated block of asked tokens is an index of grams, which every task looks its words up in."""
    distinct = asked.select("q").distinct()
    blocks = max(1, -(-distinct.count() // TOKENS))
    out = None
    for b in range(blocks):
        part = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        got = _similar(words, sorted(r.q for r in part.collect() if r.q), floor)
        out = got if out is None else out.unionByName(got)
    return out


def _similar(words: DataFrame, own: list[str], floor: float) -> DataFrame:
    share = words.sparkSession.sparkContext.broadcast(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = GramIndex(share.value), pa.array(share.value, pa.string())
        for batch in batches:
            for i, k, value in index.similar(batch.column(0).to_pylist(), floor):
                yield pa.RecordBatch.from_arrays([own.take(pa.array(k)), batch.column(0).take(pa.array(i)), pa.array(value)], ["q", "token", "similarity"])

    return words.where("token is not null").select("token").mapInArrow(work, "q string, token string, similarity double")


def fuzzy(leaves: DataFrame, queries: DataFrame, threshold: float = 0.42, case_sensitive: bool = False, best: int | None = None) -> DataFrame:
    """(query_id, leaf_id, score): the mean over a query's tokens of each one's best similarity in the leaf; leaves that any token misses are left out.

    Queries are taken in blocks, each in one pass over the leaves without a shuffle. With `best`, a row is left out if its
    task has so many better ones of the query, of whatever leaves; rows of equal score stay."""
    words = F.array_distinct(F.regexp_extract_all(T.fold(T.compatible(F.col("text")), case_sensitive), F.lit(T.WORD), F.lit(0)))
    held = leaves.select("leaf_id", F.filter(F.array_distinct(F.transform(words, T.stem)), lambda t: F.length(t) > 1).alias("tokens"))
    blocks = max(1, -(-queries.count() // QUERIES))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = _scored(held, part, threshold, case_sensitive, best)
        out = got if out is None else out.unionByName(got)
    return out


class Scorer:
    """Scores of leaves for some queries, which together have TOKENS distinct tokens at most (or are one query).

    Of each chunk of leaves, the best similarity of every query token is gathered from an index of grams. A query's tokens
    are then gone through from the one that fewest leaves have, and with the most that the rest could add: what misses
    one, or can't reach the threshold or the query's `best` so far, isn't looked at further."""

    def __init__(self, asked: list[tuple[int, dict[str, int]]], threshold: float, best: int | None):
        self.tokens = sorted({t for _, q in asked for t in q})
        place = {t: n for n, t in enumerate(self.tokens)}
        self.index = GramIndex(self.tokens)
        self.asked = [(n, np.array([place[t] for t in q], np.int64), np.array(list(q.values()), float)) for n, q in asked]
        self.least = np.full(len(asked), threshold)  # what a score must reach
        self.top = [np.zeros(0)] * len(asked)
        self.best = best
        self.known: dict[str, tuple] = {}

    def similar(self, words: list[str]) -> list[tuple]:
        """(numbers, similarities) of the query tokens similar to each word; words of this task that were met before are remembered."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = words
        none = (np.zeros(0, np.int64), np.zeros(0))
        self.known.update(dict.fromkeys(new, none))
        for i, k, value in self.index.similar(new, FLOOR):
            first = np.flatnonzero(np.diff(i, prepend=-1))
            for low, high in zip(first, [*first[1:], len(i)]):
                self.known[new[i[low]]] = k[low:high], value[low:high]
        return [self.known[w] for w in words]

    def scores(self, row, code, words: list[str], n: int) -> Iterator[tuple]:
        """(leaves, query, scores) of a chunk of n leaves; row, code: of every token its leaf and its number among words."""
        met = self.similar(words)
        length = np.array([len(k) for k, _ in met], np.int64)
        begin = np.cumsum(length) - length
        k, value = (np.concatenate([m[c] for m in met]) if met else np.zeros(0, int) for c in (0, 1))
        size = length[code]
        at = np.repeat(begin[code] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = np.zeros((len(self.tokens), n))
        np.maximum.at(found, (k[at], np.repeat(row, size)), value[at])
        often = np.count_nonzero(found, axis=1)
        most = found.max(axis=1, initial=0.0)
        for number, (q, own, times) in enumerate(self.asked):
            order = np.argsort(often[own], kind="stable")
            if not len(own) or not often[own[order[0]]]:
                continue
            rest, total = float((most[own] * times).sum()), times.sum()
            leaves = np.flatnonzero(found[own[order[0]]])
            sofar = np.zeros(len(leaves))
            for o in order:
                got = found[own[o], leaves]
                rest -= most[own[o]] * times[o]
                sofar = sofar + got * times[o]
                may = (got > 0) & (sofar + rest >= (self.least[number] - 1e-9) * total)
                leaves, sofar = leaves[may], sofar[may]
                if not len(leaves):
                    break
            if not len(leaves):
                continue
            # summed anew in the order of the tokens and rounded, so that the order of a sum never decides between equal scores
            score = np.round((found[own][:, leaves] * times[:, None]).sum(axis=0) / total, 12)
            some = score >= self.least[number]
            if some.any():
                if self.best:
                    self.top[number] = np.sort(np.concatenate((self.top[number], score[some])))[-self.best :]
                    if len(self.top[number]) == self.best:
                        self.least[number] = max(self.least[number], self.top[number][0])
                yield leaves[some], q, score[some]


def _scored(held: DataFrame, queries: DataFrame, threshold: float, case_sensitive: bool, best: int | None) -> DataFrame:
    spark = held.sparkSession
    asked: dict = {}
    for r in queries.select("query_id", T.tokens(T.compatible(F.col("query")), case_sensitive).alias("tokens")).collect():  # QUERIES at most
        own = asked.setdefault(r.query_id, {})
        for t in r.tokens or []:
            own[t] = own.get(t, 0) + 1
    kinds = held.schema["leaf_id"].dataType.simpleString(), queries.schema["query_id"].dataType
    ids = spark.createDataFrame([(q,) for q in asked], f"query_id {kinds[1].simpleString()}").toArrow().column(0).combine_chunks()
    groups: list[list] = [[]]
    together: set[str] = set()
    for n, own in enumerate(asked.values()):
        if groups[-1] and len(together | own.keys()) > TOKENS:
            groups.append([])
            together = set()
        groups[-1].append((n, own))
        together |= own.keys()
    share = spark.sparkContext.broadcast((ids, groups))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = share.value
        scorers = [Scorer(g, threshold, best) for g in groups if g]
        for batch in batches:
            for low in range(0, batch.num_rows, LEAVES):
                part = batch.slice(low, LEAVES)
                coded = pc.list_flatten(part.column(1)).dictionary_encode()
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy())
                code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                for s in scorers:
                    found = list(s.scores(row, code, words, part.num_rows))
                    if found:
                        leaf = pa.array(np.concatenate([f[0] for f in found]))
                        query = pa.array(np.repeat([f[1] for f in found], [len(f[0]) for f in found]))
                        yield pa.RecordBatch.from_arrays([ids.take(query), part.column(0).take(leaf), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "leaf_id", "score"])

    return held.mapInArrow(work, f"query_id {kinds[1].simpleString()}, leaf_id {kinds[0]}, score double")


def search(
    leaves: DataFrame, queries: DataFrame, mode: str = "auto", max_results: int = 25, threshold: float = 0.42, case_sensitive: bool = False,
) -> DataFrame:
    """Ranked results of every query: query_id, rank, leaf_id, file, branch, line, text, match, score, route.

    Exact matches come first, then higher scores, preferred files, file and line. If a preferred file has an exact
    match, the others aren't searched for exact ones; if its best row is exact, they give no rows at all. Empty queries
    give none, and null texts match nothing."""
    return _blocks(leaves, queries, mode, threshold, case_sensitive, lambda rows: _ranked(rows, leaves, max_results), max_results)


def matches(leaves: DataFrame, queries: DataFrame, mode: str = "auto", threshold: float = 0.42, case_sensitive: bool = False) -> DataFrame:
    """All that `search` would rank, without ranks and texts: query_id, leaf_id, file, line, match, score, route. Nothing is sorted, so a query with many results is no task of its own."""
    return _blocks(leaves, queries, mode, threshold, case_sensitive, lambda rows: rows)


def _blocks(leaves: DataFrame, queries: DataFrame, mode: str, threshold: float, case_sensitive: bool, then, best: int | None = None) -> DataFrame:
    if mode not in ("auto", "literal", "regex"):
        raise ValueError("mode must be auto, literal or regex")
    if "files" not in queries.columns:
        queries = queries.withColumn("files", F.lit(None).cast("array<string>"))
    queries = queries.withColumn("query", F.trim("query")).where(F.length("query") > 0)
    n, hinted = queries.agg(F.count("*"), F.count("files")).first()
    blocks = max(1, -(-n // QUERIES))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = then(_found(leaves, part, mode, threshold, case_sensitive, bool(hinted), best))
        out = got if out is None else out.unionByName(got)
    return out


def _found(leaves: DataFrame, queries: DataFrame, mode: str, threshold: float, case_sensitive: bool, hinted: bool, best: int | None) -> DataFrame:
    """(query_id, leaf_id, file, line, match, score, route) of a block of queries."""
    names = ["query_id", "leaf_id", "file", "line"]
    exact = _exact(leaves, queries, mode, case_sensitive)
    if hinted:
        any_preferred = exact.groupBy("query_id").agg(F.max("preferred").alias("any"))  # a row for each query
        exact = exact.join(F.broadcast(any_preferred), "query_id").where("preferred or not any")
    rows = exact.select(*names, F.lit("exact").alias("match"), F.lit(1.0).alias("score"))
    if threshold <= 1:  # no score is above 1, so a higher threshold asks for exact matches alone
        # rows beyond a task's best can't be among the best of all; one of score 1, which could stand for its file, is never beyond
        near = fuzzy(leaves, queries, threshold, case_sensitive, best).join(leaves.select("leaf_id", "file", "line"), "leaf_id")
        rows = rows.unionByName(near.select(*names, F.lit("fuzzy").alias("match"), "score")).groupBy(*names).agg(F.min("match").alias("match"), F.max(F.struct((F.col("match") == "exact").alias("e"), "score"))["score"].alias("score"))
    if not hinted:
        return rows.withColumn("route", F.lit("fallback"))
    preferred = F.coalesce(F.array_contains("files", F.col("file")), F.lit(False))
    rows = rows.join(F.broadcast(queries.select("query_id", "files")), "query_id").withColumn("route", F.when(preferred, "hierarchy").otherwise("fallback")).drop("files")
    # the best row of the preferred files; where it is exact, the rest of the tree isn't looked at
    best = rows.where("route = 'hierarchy'").groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "file", "line", "leaf_id", "match"))["match"].alias("top"))
    return rows.join(F.broadcast(best), "query_id", "left").where("not (coalesce(top = 'exact', false) and route = 'fallback')").drop("top")


def _ranked(rows: DataFrame, leaves: DataFrame, max_results: int) -> DataFrame:
    """The best of each query's rows, with their texts. Every task cuts what it has to max_results before rows are dealt by query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("match") == "exact"), F.desc("score"), F.desc(F.col("route") == "hierarchy"), "file", "line", "leaf_id")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, max_results))
    best = F.broadcast(best) if max_results * QUERIES <= FEW else best
    met = leaves.select(F.col("leaf_id").alias("of"), F.col("file").alias("in"), F.col("line").alias("at"), "branch", "text").join(best, (F.col("of") == F.col("leaf_id")) & F.col("in").eqNullSafe(F.col("file")) & F.col("at").eqNullSafe(F.col("line")))
    return met.select("query_id", "rank", "leaf_id", "file", "branch", "line", T.display(F.col("text")).alias("text"), "match", "score", "route")


def outcomes(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(outcome, n): how many queries were answered by hierarchy, by fallback, or missed."""
    first = results.where("rank = 1").select("query_id", "route")
    return queries.select("query_id").join(first, "query_id", "left").groupBy(F.coalesce("route", F.lit("miss")).alias("outcome")).agg(F.count("*").alias("n"))


def recall_at_1(results: DataFrame, truth: DataFrame) -> Column:
    """(queries, hits, recall) of results against truth (query_id, leaf_id)."""
    met = truth.join(results.where("rank = 1").select("query_id", F.col("leaf_id").alias("found")), "query_id", "left")
    return met.agg(F.count("*").alias("queries"), F.count_if(F.col("found") == F.col("leaf_id")).alias("hits"), F.avg((F.coalesce(F.col("found") == F.col("leaf_id"), F.lit(False))).cast("double")).alias("recall"))
