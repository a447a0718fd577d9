"""Text functions as Column expressions: folding, tokens, stems, trigrams, similarities, keys and hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The plural and possessive endings that a search token loses, tried in this order.
ENDINGS = ("larınız", "leriniz", "larımız", "lerimiz", "ları", "leri", "lar", "ler")
# Words that don't count when leaves are compared for duplication.
AUDIT_STOP = ("the", "ve", "and", "for", "with", "chose", "alt", "none", "ok", "to", "bir", "ile", "için", "of", "in", "on", "is", "bkz")
#: Of metadata comments in documents, <!-- prefix:key:value -->.
PREFIX = "note"
# Words that can't name a cluster; the last is the tree's own prefix.
CLUSTER_STOP = ("the", "and", "for", "with", "from", "into", "that", "this", "then", "than", "ve", "bir", "ile", "için", "ama", "daha", "bkz", "root", PREFIX)
# Fixed value: how a leaf refers to a branch of another root; \z, as $ would also match before a last line feed.
REFERENCE = r"(?iu)\bbkz:\s*((?:root|kök|kok)-?\d+)(?:\s*/\s*([^\n();]+?))?(?=\s*(?:[();]|\z))"
# What a word of a search and a date of an entry are.
WORD = r"[\p{L}\p{N}]+(?:'\p{L}+)?"
DATE = r"\b\d{2}\.\d{2}\.\d{4}\b"


@F.arrow_udf(StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    # in slices, so that few texts at a time are Python's
    one = lambda x: None if x is None else unicodedata.normalize("NFKC", x)
    parts = [pa.array([one(x.as_py()) for x in s.slice(at, 64)], pa.string()) for at in range(0, len(s), 64)]
    return pa.concat_arrays(parts) if parts else s


def _inert() -> str:
    """A regex class of characters that NFKC leaves as they are whatever other of them stand beside them: of some blocks that hold none that joins one before it but combining marks."""
    ranges: list[list[int]] = []
    for low, high in ((0x80, 0x24F), (0x370, 0x52F), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF)):
        for code in range(low, high + 1):
            if unicodedata.is_normalized("NFKC", chr(code)) and not unicodedata.combining(chr(code)):
                if ranges and ranges[-1][1] == code - 1:
                    ranges[-1][1] = code
                else:
                    ranges.append([code, code])
    return r"[\p{ASCII}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


INERT = _inert()


@F.pandas_udf(StringType())
def _slug(s: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        kept = "".join(c for c in unicodedata.normalize("NFKD", x.strip().lower()) if not 0x300 <= ord(c) <= 0x36F)
        out = "".join(c if unicodedata.category(c)[0] in "LN" else "-" for c in kept)
        return "-".join(filter(None, out.split("-")))

    return s.map(one, na_action="ignore")


def compatible(c: Column) -> Column:
    """NFKC. Spark has no expression for it, so this is an Arrow UDF; only texts that hold others than INERT characters, which alone can change, are sent to it."""
    plain = c.rlike(rf"\A(?:\p{{ASCII}}++|{INERT}++)*+\z")
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def slug(c: Column) -> Column:
    """Letters and digits without accents in lower case, joined by hyphens; empty where nothing is left."""
    return _slug(c)


def fold(c: Column, case_sensitive: bool = False) -> Column:
    """Apostrophes made alike and, unless case counts, lower case by Turkish rules (I becomes ı, İ becomes i). Expects NFKC text (`compatible`)."""
    c = F.translate(c, "’`", "''")
    return c if case_sensitive else F.lower(F.translate(c, "Iİ", "ıi"))


def stem(token: Column) -> Column:
    """A folded token up to its apostrophe, without the first of ENDINGS that leaves four characters or more."""
    base = F.when(F.instr(token, "'") > 1, F.substring_index(token, "'", 1)).otherwise(token)
    out = base
    for end in reversed(ENDINGS):
        out = F.when(base.endswith(end) & (F.length(base) - len(end) >= 4), F.substring(base, F.lit(1), F.length(base) - len(end))).otherwise(out)
    return out


def tokens(c: Column, case_sensitive: bool = False) -> Column:
    """Stems of all words with more than one character, repeats included."""
    found = F.regexp_extract_all(fold(c, case_sensitive), F.lit(WORD), F.lit(0))
    return F.filter(F.transform(found, stem), lambda t: F.length(t) > 1)


def trigrams(c: Column) -> Column:
    """The set of 3-grams of the text with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """Trigram similarity of two tokens: 1 if equal, else twice the common grams over all."""
    x, y = trigrams(a), trigrams(b)
    return F.when(a == b, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def _split(c: Column, stop: tuple[str, ...]) -> Column:
    # repeats and stop words go first, in one pass over a set, so that only different words are tested one by one
    parts = F.array_except(F.split(c, r"[^\p{L}\p{N}-]+"), F.array(*map(F.lit, stop)))
    return F.filter(parts, lambda t: F.length(t) > 2)


def audit_tokens(c: Column) -> Column:
    """The set of words by which leaves are compared: lower case, without emphasis marks, dates, short words and AUDIT_STOP."""
    # of the marks only underscores are replaced, beside which a date wouldn't begin or end; the others part words as they are
    return _split(F.regexp_replace(F.replace(F.lower(c), F.lit("__"), F.lit(" ")), DATE, " "), AUDIT_STOP)


def keyword_tokens(c: Column) -> Column:
    """The sorted set of words that can name a cluster."""
    return F.array_sort(_split(F.regexp_replace(F.lower(c), DATE, " "), CLUSTER_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def branch_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_-]+", "-")


def root_number(file: Column) -> Column:
    """The first number of a root's file name; null if it has none."""
    found = F.regexp_extract(file, r"(?:^|-)(\d+)(?:[-_]|$)", 1)
    return F.when(found != "", found)


def references(c: Column) -> Column:
    """Array of (place, human, number, branch) of the references in a text."""
    pattern = F.lit(REFERENCE)
    zipped = F.arrays_zip(*[F.regexp_extract_all(c, pattern, F.lit(i)).alias(n) for i, n in enumerate(("human", "root", "branch"))])
    clean = lambda b: F.trim(F.regexp_replace(F.trim(b), r"[*_`.,:]+$", ""))
    return F.transform(zipped, lambda x, i: F.struct(i.alias("place"), x["human"].alias("human"), F.regexp_extract(x["root"], r"\d+", 0).alias("number"), clean(F.coalesce(x["branch"], F.lit(""))).alias("branch")))


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys and no spaces, by way of a variant. Exponent-form numbers keep the variant's form."""
    return F.to_json(F.parse_json(c))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def edge_id(source: Column, target: Column, status: Column, human: Column) -> Column:
    """e_ and 24 hex digits of the hash of the edge's canonical JSON; its keys are sorted as written here."""
    text = F.to_json(F.struct(human.alias("human"), source.alias("sourceId"), status.alias("status"), target.alias("targetId")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("e_"), F.substring(F.sha2(text, 256), 1, 24))


def human_reference(number: Column, branch: Column) -> Column:
    return F.format_string("bkz: Root-%s / %s", number, branch)


def title(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def typo(c: Column) -> Column:
    """Characters 3 and 4 exchanged, in texts of four or more."""
    swapped = F.concat(F.substring(c, 1, 2), F.substring(c, 4, 1), F.substring(c, 3, 1), F.substring(c, F.lit(5), F.length(c)))
    return F.when(F.length(c) >= 4, swapped).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.round(F.length(c) / 4).cast("long")


def display(c: Column) -> Column:
    """One line, 300 characters at most."""
    return F.substring(F.regexp_replace(c, r"\s*\n\s*", " "), 1, 300)


def preview(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, 100)
