"""License scans by a positional rare-token index, in DataFrame expressions only (operator 5).

Every template has key phrases that must stand in a file. Of the first one's words those with the highest inverse
document frequency, counted over all files, are the template's anchors; the index maps each anchor word to its postings
(template, position). A file's words are looked up in it once, every hit votes for a template's start, and a template
may begin where all its anchors vote for the same start, so postings are intersected by relative position. Then its key
phrases are verified word by word, and its words are compared with those that stand there. As anchors are mandatory
words, which words are rare decides about the work, not about the outcome."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts as texts
from .common import ascii_lower, unlike

#: Between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template that are looked up.
ANCHORS = 3


def words_of(text: str) -> list[str]:
    return re.sub(GAP, " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()


@dataclass(frozen=True)
class Template:
    """keys: phrases of the text; the first must stand as it is, each other one within the slack of its place from it.
    share: of the text's different words, how many must stand there. Words that were put in or left out move what
    follows them; the slack, a tenth of the text's words, is for these."""

    label: str
    text: str
    keys: tuple[str, ...]
    share: float = 0.8
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)

    @cached_property
    def slack(self) -> int:
        return len(self.words) // 10 if len(self.keys) > 1 else 0

    @cached_property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """Each key phrase's place in the text and its words."""
        out = []
        for key in map(words_of, self.keys):
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key), key))
        return out


#: Phrases whose places are counted; each is its own key phrase, so all its words must agree.
BASE = tuple(Template(label, text, (text,), 1.0, True) for label, text in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")))
#: Whole texts and notices of public licences, then the names by which they are referred to.
MORE = (
    Template("mit", texts.MIT, ("free of charge to any person obtaining a copy of this software", "provided as is without warranty of any kind")),
    Template("isc", texts.ISC, ("for any purpose with or without fee is hereby granted", "the author disclaims all warranties")),
    Template("bsd-3", texts.BSD_3, ("redistributions of source code must retain", "used to endorse or promote products", "advised of the possibility of such damage")),
    Template("bsd-2", texts.BSD_2, ("redistributions of source code must retain", "advised of the possibility of such damage")),
    Template("zlib", texts.ZLIB, ("the origin of this software must not be misrepresented", "may not be removed or altered")),
    Template("unlicense", texts.UNLICENSE, ("free and unencumbered software", "detriment of our heirs and successors")),
    Template("bsl-1", texts.BOOST, ("any person or organization obtaining a copy", "machine executable object code")),
    Template("apache-2", texts.APACHE_NOTICE, ("licensed under the apache license", "except in compliance with the license")),
    *(Template(f"gpl-{v}", texts.gnu_notice("GNU General Public License", v), ("terms of the gnu general public license", f"either version {v} of the license")) for v in "23"),
    *(Template(f"lgpl-{v.replace(' ', '.')}", texts.gnu_notice("GNU Lesser General Public License", v), ("terms of the gnu lesser general public license", f"either version {v} of the license")) for v in ("2 1", "3")),
    Template("agpl-3", texts.gnu_notice("GNU Affero General Public License", "3"), ("terms of the gnu affero general public license", "either version 3 of the license")),
    Template("mpl-2", texts.MPL_NOTICE, ("terms of the mozilla public license", "copy of the mpl was not distributed")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person",), 0.93),
    *(Template(label, name, (name,), 1.0) for label, name in (
        ("apache-2", "licensed under the apache license"), ("gpl-3", "gnu general public license version 3"), ("gpl-2", "gnu general public license version 2"),
        ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"), ("bsd", "redistribution and use in source and binary forms"), ("mpl-2", "mozilla public license v 2 0"),
        ("unlicense", "free and unencumbered software"), ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc0", "cc0 1 0 universal"), ("bsl-1", "boost software license"), ("proprietary", "all rights reserved"),
    )),
)


def flat(text: Column) -> Column:
    """The words with a space between them; empty without any."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " "))


def frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """In how many files each word of the templates' first key phrases stands: at most as many rows as there are such words."""
    known = sorted({w for t in templates for w in t.phrases[0][1]})
    own = F.filter(F.split(flat(F.col(text)), " "), lambda w: w.isin(known))
    counted = docs.select(F.explode(F.array_distinct(own)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r.w: r.n for r in counted.collect()}


def anchors(templates: tuple[Template, ...], seen: dict[str, int], most: int = ANCHORS) -> list[list[tuple[str, int]]]:
    """Of each template the words of its first key phrase that are in the fewest files, and their positions in the text; of equals, the first."""
    out = []
    for t in templates:
        at, key = t.phrases[0]
        order = sorted(range(len(key)), key=lambda i: (seen.get(key[i], 0), i))
        out.append([(key[i], at + i) for i in order[:most]])
    return out


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = MORE) -> DataFrame:
    """One row for every row of docs: key, n_words, places (array of label, base, start, share, for each place at which a template holds).

    A null text is empty; repeated rows come out each; the key may be null; other columns are not looked at. Starts are
    word numbers from 0, that of a template whose first words are missing may be below 0. docs is read twice, first to
    count words. There is no shuffle but that of these counts, and words are looked up only in texts that hold an
    anchor at all. The work for a file grows with the hits of its words, not with the number of templates."""
    unlike(key, "n_words", "places")
    templates = (*BASE, *templates)
    own = anchors(templates, frequencies(docs, templates, text))
    posts: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for n, found in enumerate(own):
        for word, at in found:
            posts[word].append((n, at))
    names = sorted(posts)
    index = F.create_map(*(c for w in names for c in (F.lit(w), F.array(*(F.struct(F.lit(n).alias("t"), F.lit(at).alias("at")) for n, at in posts[w])))))
    needs = F.array(*(F.lit(len(a)) for a in own))
    facts = F.array(*(
        F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.share).alias("least"), F.lit(t.slack).alias("slack"), F.lit(len(t.words)).alias("size"), _strings(sorted(set(t.words))).alias("words"),
                 F.array(*(F.struct(F.lit(at).alias("at"), _strings(k).alias("words")) for at, k in t.phrases)).alias("keys"))
        for t in templates
    ))
    docs = docs.select(F.col(key).alias("key"), flat(F.col(text)).alias("flat")).withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")))
    words = F.col("words")

    def votes(hits: Column) -> Column:
        """Sorted (template, start), one for each anchor that has its place there."""
        return F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(index, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("s"))))))

    def agreed(all_: Column) -> Column:
        return F.filter(all_, lambda v, i: F.coalesce(F.get(all_, i + F.get(needs, v["t"]) - 1) == v, F.lit(False)))

    def stands(k: Column, s: Column, slack: Column) -> Column:
        """Whether a key phrase stands at its place from s on, or within the slack of it."""
        at = lambda d: (s + k["at"] + d >= 0) & (F.slice(words, F.greatest(s + k["at"] + d, F.lit(0)) + 1, F.size(k["words"])) == k["words"])
        return F.exists(F.sequence(-slack, slack), at)

    def place(v: Column) -> Column:
        t, s = F.get(facts, v["t"]), v["s"]
        first = F.greatest(s - t["slack"], F.lit(0))
        here = F.slice(words, first + 1, F.greatest(s + t["size"] + t["slack"] - first, F.lit(0)))
        share = F.size(F.array_intersect(t["words"], here)) / F.size(t["words"])
        sure = stands(F.get(t["keys"], F.lit(0)), s, F.lit(0)) & F.forall(F.slice(t["keys"], 2, F.size(t["keys"])), lambda k: stands(k, s, t["slack"]))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), s.cast("long").alias("start"), F.when(sure, share).otherwise(0.0).alias("share"), t["least"].alias("least"))

    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(names))
    some = F.col("flat").rlike(f"(?:^| )(?:{'|'.join(map(re.escape, names))})(?: |$)")
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731 - evaluates value once
    found = bind(votes(hits), lambda all_: F.filter(F.transform(agreed(all_), place), lambda x: x["share"] >= x["least"]))
    places = F.transform(F.when(some, found), lambda x: x.dropFields("least"))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    return docs.select(F.col("key").alias(key), F.size("words").cast("long").alias("n_words"), F.coalesce(places, empty).alias("places"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template) of what scan() gives."""
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    names = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))))
    return scanned.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
