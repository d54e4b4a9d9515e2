"""words within a few edits of each other, as an equi-join on segments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.common import broadcast_if_small

MOST = 2


def edits_allowed(c: Column) -> Column:
    """None up to two characters, one up to five, else two."""
    return F.when(F.length(c) <= 2, 0).when(F.length(c) <= 5, 1).otherwise(MOST)


def _segment(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of segment i (from 1) of a word cut into n + 1 parts, the longer ones last."""
    base = F.floor(length / (n + 1)).cast("int")
    short = n + 1 - length % (n + 1)
    return 1 + (i - 1) * base + F.greatest(i - 1 - short, F.lit(0)), base + (i > short).cast("int")


def near_words(asked: DataFrame, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """(term, match, distance) of each distinct asked word against the distinct words of a vocabulary.

    A word that n edits turn into another leaves one of the n + 1 segments of the other whole, and the i-th
    segment is moved by less than i places, as seen from either end.  So a vocabulary word gives n + 1 keys (its length,
    the segment's number and text) for each n in use, an asked word a few dozen, whatever their lengths; pairs
    that share a key are verified by their edit distance.  A word that no edit may change is one segment.  The vocabulary
    is read once.  While the asked words' keys are small (checked) they are broadcast: the vocabulary's keys are not
    shuffled, and a segment of many words is no single task.  Segments travel as hashes: a token of any length is a
    small row.
    """
    words = vocabulary.select(F.col(term).alias("match")).filter(F.length("match") > 0).distinct()
    n, length = F.col("n"), F.length("match")
    i = F.col("i")
    start, size = _segment(length, n, i)
    fits = (n == 0) & (length <= 2) | (n == 1) & length.between(2, 6) | (n == 2) & (length >= 4)
    kept = words.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter(fits).withColumn(
        "i", F.explode(F.sequence(F.lit(1), n + 1))).select(
        "match", "n", "i", length.alias("l"), F.xxhash64(F.substring("match", start, size)).alias("part"))

    own = F.length(term)
    wanted = asked.select(term).filter(own > 0).distinct().withColumn("n", edits_allowed(F.col(term)))
    some = wanted.withColumn("l", F.explode(F.sequence(F.greatest(own - n, n + 1), own + n))).withColumn(
        "i", F.explode(F.sequence(F.lit(1), n + 1)))
    start, size = _segment(F.col("l"), n, i)
    moved = own - F.col("l")
    low = F.greatest(F.lit(1), start - (i - 1), start + moved - (n + 1 - i))
    high = F.least(own - size + 1, start + (i - 1), start + moved + (n + 1 - i))
    keys = some.withColumn("p", low).withColumn("q", high).filter("p <= q").withColumn(
        "at", F.explode(F.sequence("p", "q"))).select(
        term, "n", "i", "l", F.xxhash64(F.substring(F.col(term), F.col("at"), size)).alias("part"))
    pairs = kept.join(broadcast_if_small(keys), ["n", "i", "l", "part"]).select(term, "match", "n").distinct()
    return pairs.withColumn("distance", F.levenshtein(term, "match", MOST)).filter(
        (F.col("distance") >= 0) & (F.col("distance") <= F.col("n"))).select(term, "match", "distance")
