"""Secret scans by a trigram inverted index, in DataFrame expressions only (operator 6).

A Boolean query of trigrams is derived from each rule's pattern: what every match must contain. The index holds, for
the trigrams of these queries, postings of text hashes in blocks of bounded size; postings are intersected and united
block by block as the queries say, and only the texts of the outcome are matched against the rule. A rule without
mandatory trigrams is matched against every text."""

from __future__ import annotations

import math
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import fresh
from .common import ascii_lower, cut

#: Texts in a block of postings, on average.
BLOCK = 1 << 14
#: So many candidate texts (16 bytes each) are broadcast at most; more are joined by a shuffle.
FEW = 1 << 20
EMPTY = "array<bigint>"
#: The column of spans that scan() adds, if no other name is given.
SPANS = "_spans"
#: Code points of a text that are cut out together when it is masked.
PIECE = 1024


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that a group (0: the match) must have at least.
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: In the order in which spans of one start are listed. Runs of 32 hex digits or more are what {32,} matches too.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, False, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, False, True),
)
#: Published forms of well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"authorization:\x20*bearer\x20+[A-Za-z0-9._~+/-]{16,}", 0, 1, True),
    Rule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[^\s:@/]{3,}@"),
)


def query(pattern: str) -> tuple:
    """('and', q...) or ('or', q...) of trigrams, in lower case, that every match contains; ('and',) demands none."""

    def runs(items) -> tuple:
        parts, run = [], ""

        def close() -> None:
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in items:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if op is sre.MAX_REPEAT or op is sre.MIN_REPEAT:
                low, high, inner = arg
                if low == high == 1 or low >= 1 and len(inner) == 1 and inner[0][0] is sre.LITERAL and inner[0][1] < 128:
                    run += chr(inner[0][1]).lower() if inner[0][0] is sre.LITERAL else ""
                    close()
                    continue
                close()
                if low >= 1:
                    parts.append(runs(inner))
                continue
            close()
            if op is sre.SUBPATTERN:
                parts.append(runs(arg[3]))
            elif op is sre.BRANCH:
                ways = [runs(b) for b in arg[1]]
                if all(w != ("and",) for w in ways):
                    parts.append(("or", *ways))
        close()
        parts = [p for p in dict.fromkeys(parts) if p != ("and",)]
        return ("and", *parts)

    return runs(parser.parse(pattern))


def grams(q) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(grams, q[1:])) if len(q) > 1 else set()


def postings(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """(gram, block, texts): for each wanted trigram (lower case), hashes of the texts that contain it, in blocks of about BLOCK texts."""
    blocks = max(1, math.ceil(docs.count() / BLOCK))
    low = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), ascii_lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(wanted)]))
    rows = low.select("h", F.explode(held).alias("gram"))
    return rows.groupBy("gram", F.pmod("h", F.lit(blocks)).alias("block")).agg(F.collect_set("h").alias("texts"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """(h, rules): hashes of texts and, as bits, the rules whose queries they satisfy; rules without mandatory trigrams are left out."""
    asked = {n: q for n, r in enumerate(rules) if grams(q := query(r.pattern))}
    wanted = sorted(set().union(*map(grams, asked.values())))
    place = {g: F.coalesce(F.col(f"g{i}"), F.array().cast(EMPTY)) for i, g in enumerate(wanted)}

    def met(q) -> Column:
        if isinstance(q, str):
            return place[q]
        parts = [met(x) for x in q[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = F.array_intersect(out, p) if q[0] == "and" else F.array_union(out, p)
        return out

    index = postings(docs, wanted, text)
    by_block = index.groupBy("block").agg(*[F.first(F.when(F.col("gram") == i, F.col("texts")), ignorenulls=True).alias(f"g{i}") for i in range(len(wanted))])
    found = F.array(*[F.struct(F.lit(1 << n).cast("long").alias("rule"), met(q).alias("texts")) for n, q in asked.items()])
    each = by_block.select(F.explode(found).alias("x")).select("x.rule", F.explode("x.texts").alias("h"))
    return each.groupBy("h").agg(F.bit_or("rule").alias("rules"))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, both) -> Column:
    """Of an array of longs, the first elements taken together by both(a, b), up to each. The array is cut into as many
    runs as each has elements, so n elements take n times the root of n steps."""
    of = lambda part: F.aggregate(F.slice(part, 2, F.size(part)), F.element_at(part, 1), both)

    def sums(v: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(v))).cast("int")
        count = F.ceil(F.size(v) / run).cast("int")
        whole = F.transform(F.sequence(F.lit(0), count - 1), lambda c: of(F.slice(v, c * run + 1, run)))

        def upto(runs: Column) -> Column:
            before = F.transform(runs, lambda x, c: F.when(c > 0, of(F.slice(runs, 1, c))))
            return _let(before, lambda before: F.transform(v, lambda x, i: placed(before, i)))

        def placed(before: Column, i: Column) -> Column:
            c = F.floor(i / run).cast("int")
            here = of(F.slice(v, c * run + 1, i - c * run + 1))
            return F.when(c > 0, both(F.get(before, c), here)).otherwise(here)

        return F.when(F.size(v) > 0, _let(whole, upto)).otherwise(v)

    return _let(values, sums)


def spans(text: Column, rules: tuple[Rule, ...], here: list[Column]) -> Column:
    """Sorted array of (start, n, end) of the leftmost non-overlapping matches of the rules that are here, n by n, with enough characters, in code points.

    A text is cut by a rule into gaps and matches in turn, whose lengths sum to the text's; so one running sum over those
    of all rules gives every start, as a remainder by the text's length."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")

    def pieces(n: int, r: Rule) -> Column:
        pattern = F.lit(r.java)
        whole = F.regexp_extract_all(text, pattern, F.lit(0))
        cuts = F.arrays_zip(F.split(text, r.java, -1).alias("gap"), whole.alias("whole"), (F.regexp_extract_all(text, pattern, F.lit(r.group)) if r.group else whole).alias("own"))
        made = F.transform(cuts, lambda x: F.struct(F.lit(n).alias("n"), size(x["gap"]).alias("gap"), size(x["whole"]).alias("size"), (size(x["own"]) >= r.least).alias("kept")))
        return F.when(here[n], made).otherwise(F.array().cast("array<struct<n:int,gap:bigint,size:bigint,kept:boolean>>"))

    def placed(cut: Column) -> Column:
        ends = running(F.transform(cut, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        held = F.filter(F.arrays_zip(cut.alias("x"), ends.alias("end")), lambda z: z["x"]["kept"] & (z["x"]["size"] > 0))

        def span(z: Column, length: Column) -> Column:
            start = F.pmod(z["end"] - z["x"]["size"], length)
            return F.struct(start.cast("int").alias("start"), z["x"]["n"].alias("n"), (start + z["x"]["size"]).cast("int").alias("end"))

        return F.array_sort(_let(F.length(text), lambda length: F.transform(held, lambda z: span(z, length))))

    return _let(F.flatten(F.array(*(pieces(n, r) for n, r in enumerate(rules)))), placed)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = MORE, out: str = SPANS) -> DataFrame:
    """docs with a column `out`: array of (start, n, end) over BASE and the rules, sorted; n is the rule's number.

    A null text is empty, and has an empty array. Repeated rows are kept as they are, no column but text is looked at,
    and none but `out` is added or, if it is there, replaced. Texts are found again by their hash; if two texts share one,
    both are matched, so the outcome is the same. Candidates beyond FEW are joined by a shuffle, into which only texts go
    that hold the trigrams of a rule: the others have no match. The work grows with a text's n matches as n times the root of n."""
    rules = (*BASE, *rules)
    asked = {n: q for n, r in enumerate(rules) if grams(q := query(r.pattern))}
    found = cut(candidates(docs, rules, text))
    names = docs.columns
    h, of, bits = (fresh(x, names) for x in ("h", "of", "bits"))
    found = found.select(F.col("h").alias(of), F.col("rules").alias(bits))
    keyed = docs.withColumn(h, F.xxhash64(text))
    if found.count() <= FEW:
        met = keyed.join(F.broadcast(found), F.col(h) == F.col(of), "left")
    else:
        low = fresh("low", names)
        some = reduce(lambda a, b: a | b, (_holds(q, F.col(low)) for q in asked.values())) if asked else F.lit(False)
        marked = keyed.withColumn(low, ascii_lower(F.col(text))).withColumn(low, F.coalesce(some, F.lit(False)))
        met = marked.where(low).drop(low).join(found, F.col(h) == F.col(of), "left").unionByName(marked.where(~F.col(low)).drop(low), allowMissingColumns=True)
    own = F.coalesce(F.col(text), F.lit(""))
    here = [F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(1 << n) != 0 if n in asked else own.rlike(r.java) for n, r in enumerate(rules)]
    none = F.array().cast("array<struct<start:int,n:int,end:int>>")
    any_ = reduce(lambda a, b: a | b, here)
    return met.withColumn(out, F.when(any_, spans(own, rules, here)).otherwise(none)).select(*(F.col(f"`{c}`") for c in names if c != out), out)


def _holds(q, low: Column) -> Column:
    """Whether a text in lower case satisfies a query."""
    if isinstance(q, str):
        return low.contains(q)
    return reduce(lambda a, b: a & b if q[0] == "and" else a | b, (_holds(x, low) for x in q[1:]))


def digest(scanned: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """key, n_ of each base kind, base_sha256 and spans of what scan() gives."""
    kinds = F.array(*[F.lit(r.kind) for r in (*BASE, *rules)])
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["n"] + 1), x["start"], x["end"])))
    count = lambda n: F.size(F.filter(SPANS, lambda x: x["n"] == n)).cast("long")
    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return scanned.select(key, *counts, F.sha2(said(F.filter(SPANS, lambda x: x["n"] < len(BASE))), 256).alias("base_sha256"), said(F.col(SPANS)).alias("spans"))


def redact(scanned: DataFrame, text: str = "text", mask: str = "[secret]", spans: str = SPANS) -> DataFrame:
    """What scan() gives, with the mask in place of every span; overlapping spans are masked as one. The column of spans is dropped.

    A text is taken in pieces of PIECE code points, so what stands between two spans is found without counting from the
    text's beginning."""
    own = F.col(text)

    def masked(found: Column) -> Column:
        reach = running(F.transform(found, lambda x: x["end"].cast("long")), lambda a, b: F.greatest(a, b))
        return _let(reach, lambda reach: _let(F.regexp_extract_all(own, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda parts: kept(found, reach, parts)))

    def kept(found: Column, reach: Column, parts: Column) -> Column:
        before = F.transform(found, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(reach, i - 1)).cast("int").alias("a"), x["start"].alias("b"), i.alias("i")))
        apart = F.filter(before, lambda x: (x["i"] == 0) | (x["b"] >= x["a"]))
        tail = between(parts, F.element_at(reach, -1).cast("int"), F.length(own))
        return F.concat(F.array_join(F.transform(apart, lambda x: F.concat(between(parts, x["a"], x["b"]), F.lit(mask))), ""), tail)

    def between(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head = F.coalesce(F.substring(F.get(parts, first), a % PIECE + 1, F.when(first == last, b - a).otherwise(PIECE)), F.lit(""))
        rest = F.concat(F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.coalesce(F.substring(F.get(parts, last), F.lit(1), b % PIECE), F.lit("")))
        return F.when(first == last, head).otherwise(F.concat(head, rest))

    return scanned.withColumn(text, F.when(F.size(spans) > 0, masked(F.col(spans))).otherwise(own)).drop(spans)
