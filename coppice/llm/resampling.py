"""Target-distribution importance resampling without exploding rows for their scores (operator 11).

A text's features are its runs of one to three words, hashed to buckets: higher-order functions make each text's array of
buckets, which is kept in files until the scores are there. Of all texts only the count of each bucket is shuffled,
after a partial sum in every task. The logarithm of how
much more frequent a bucket is in the target is its gain, rounded down; the gains are one literal array in the plan,
and a text's weight is an aggregate over the elements of that array. Gumbel noise from the key makes a draw without
replacement in proportion to the weights a plain top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, stored, unlike

#: What separates words: all ASCII characters but digits and a-z, after case is folded.
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Steps into which scores are counted to find those that may be drawn.
STEPS = 4096


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(ascii_lower(t))  # the first is faster, and right for ASCII
    return F.filter(F.split(low, SPLIT), lambda w: w != "")


def bucketed(docs: DataFrame, buckets: int, longest: int, key: str | None, text: str) -> DataFrame:
    """(key, n_words, buckets): the bucket of every run of 1 to `longest` consecutive words of a text."""

    def runs(w: Column, shorter: Column, size: int) -> Column:
        """Buckets of the runs of `size` words and more; shorter: the runs of one word less."""
        if size == 1:
            each = w
        else:
            begins = F.slice(shorter, F.lit(1), F.greatest(F.size(shorter) - 1, F.lit(0)))
            each = F.transform(begins, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + (size - 1))))
        bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
        # what is used twice is an element of an array, so that the inner functions get it as a variable: it is made once
        more = lambda e: F.concat(F.transform(e, bucket), runs(w, e, size + 1)) if size < longest else F.transform(e, bucket)
        return more(w) if size == 1 else F.get(F.transform(F.array(each), more), 0) if size < longest else more(each)

    both = F.transform(F.array(words(F.col(text))), lambda w: F.struct(F.size(w).alias("n_words"), runs(w, w, 1).alias("buckets")))
    return docs.select(*([F.col(key)] if key else []), F.inline(both))


def counted(held: DataFrame) -> dict[int, int]:
    """How often each bucket occurs in all texts: as many numbers as there are buckets at most."""
    each = held.select(F.explode("buckets").alias("bucket"))
    return {r["bucket"]: r["n"] for r in each.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed frequency in the target over that in the source."""
    all_s, all_t = sum(source.values()), sum(target.values())
    return [math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (all_s + buckets)) / float((source.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)]


def weighed(held: DataFrame, gain: list[int], key: str) -> DataFrame:
    """(key, n_words, n_features, weight): the sum of the gains of a text's features."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal when the plan is made
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    return held.select(key, "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))


def ranked(scored: DataFrame, may: Column, take: int, key: str) -> DataFrame:
    """scored with the rank of the `take` rows of highest score among those that may be drawn, ties by key; null for the others.

    The scores are counted in STEPS equal steps; only rows from the step on in which the last one to be drawn lies are
    sorted, by ranges of (score, key), and ranks are their places in a range after all earlier ranges."""
    none = F.lit(None).cast("long").alias("rank")
    low, high = scored.where(may).agg(F.min("score"), F.max("score")).first()
    if take <= 0 or low is None:
        return scored.select("*", none)
    step = ((F.col("score") - low) / F.lit(high - low + 1).cast("double") * STEPS).cast("int")  # never falls where the score rises
    left, edge = take, 0
    for r in sorted(scored.where(may).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        edge, left = r["step"], left - r["n"]
        if left <= 0:
            break
    near = F.coalesce(may & (step >= edge), F.lit(False))
    ordered = cut(scored.where(near).orderBy(F.desc("score"), F.asc(key)).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"])
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    offset = scored.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    drawn = ordered.join(F.broadcast(offset), part == F.col("_part")).select(*scored.columns, F.when(rank <= take, rank).alias("rank"))
    return scored.where(~near).select("*", none).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """One row for every row of docs: key, n_words, n_features, weight, score, rank.

    Draws floor(percent N / 100) of the N rows with at least `least_words` words, by importance for the target's texts:
    rank is 1, 2, 3... by score downwards and then by key, null for rows that aren't drawn. weight is the sum of a text's
    gains, score the weight plus Gumbel noise in thousandths that depends on seed and key only. A null or empty text has
    no words and weighs 0. A row with a null key has no noise: its score is null, and it neither counts nor is drawn; its
    words count all the same. Rows of the same key have the same noise; among those of equal score it is open which is
    ranked first. With an empty target, or no docs, all gains follow from the smoothing alone. Other columns don't matter."""
    unlike(key, "n_words", "n_features", "weight", "score", "rank", "words", "buckets", "_at", "_part", "_before")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    with stored(bucketed(docs, buckets, longest, key, text)) as held:
        gain = gains(counted(held), counted(bucketed(target, buckets, longest, None, target_text)), buckets)
        scored = cut(weighed(held, gain, key).withColumn("score", F.col("weight") + noise))
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    return ranked(scored, may, percent * scored.where(may).count() // 100, key)
