"""Connected components by alternating large and small stars over stored edge tables."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes other than it, from edges (a, b).

    Every round hooks each node's larger neighbours, then its smaller ones, to its smallest neighbour, until nothing
    changes.  Minima are aggregated before they are shuffled, so a hub does not gather its neighbours in one task.
    """
    def stars(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            e = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = e.join(least, "u")
        if larger:
            made = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return made.filter("a <> b").distinct()

    now = scratch.store(edges.select("a", "b").filter("a <> b").distinct())
    state = None
    for _ in range(rounds):
        new = scratch.store(stars(stars(now, True), False))
        scratch.drop(now)
        now, before = new, state
        r = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b"))).first()
        state = tuple(r)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[k] and b[k] for all k, in rounds over whole arrays."""
    while len(a):
        ra, rb = find(root, a), find(root, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def find(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The root of each set."""
    at = root[at]
    while True:
        up = root[at]
        if np.array_equal(up, at):
            return at
        at = up
