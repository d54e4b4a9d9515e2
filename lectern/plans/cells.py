"""F7, approximate mode: vectors in coarse cells, searched by probing each question's nearest cells."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.vectors import l2_normalize
from lectern.operators.access import EVERYTHING, Visibility
from lectern.plans import search as S
from lectern.plans.common import store, top_k


@dataclass(frozen=True)
class Cells:
    """Unit centres, one a row, and how many of a question's nearest cells reach the recall asked for."""
    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        near = -(vectors @ self.centres.T)
        n = min(n, near.shape[1])
        at = np.argpartition(near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(at, np.argsort(np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)


def fit_cells(vectors: np.ndarray, cells: int, k: int, recall: float, rounds: int = 8, seed: int = 3) -> Cells:
    """Spherical k-means over some unit vectors, and the probes that find `recall` of their k nearest among them."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    made = Cells(centres, len(centres))
    asked = rng.choice(len(vectors), min(256, len(vectors)), replace=False)
    scores = vectors[asked] @ vectors.T
    true = np.argpartition(-scores, min(k, len(vectors) - 1), axis=1)[:, :min(k + 1, len(vectors))]
    place = np.argsort(made.nearest(vectors[asked], len(centres)), axis=1)      # of each cell in a question's order
    needed = np.take_along_axis(place, np.argmax(vectors @ centres.T, axis=1)[true], 1).ravel()
    return Cells(centres, int(np.quantile(needed, recall, method="higher")) + 1)


def approximate_search(questions: DataFrame, sections: DataFrame, k: int = 10, grants: DataFrame | Visibility | None = None,
                       cells: int = 256, sample: int = 20_000, recall: float = 0.97, block_rows: int = 20_000,
                       block_queries: int = 2_000) -> DataFrame:
    """near sections by cosine, exact within the cells probed; access rules come before scoring (F16).

    Centres are fitted on at most ``sample`` sections, those with the smallest hash of their id, and on these the number
    of probes is set so that ``recall`` of the k nearest lie in probed cells.  Every section is indexed.  A cell of any
    size is cut into blocks of rows, its questions into blocks as well; only ``k`` rows a question leave a pair of
    blocks.  A question without a vector has no hits.
    """
    unit = lambda df, *c: df.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(
        *c, l2_normalize(F.col("vector")).alias("v"))
    see = S._access(questions, grants)
    ss, qs = unit(sections, "section_id", "doc_id"), unit(questions, "query_id")
    schema = S._hits(qs, ss)
    drawn = ss.orderBy(F.xxhash64("section_id"), "section_id").limit(sample).select("v").toPandas()
    if drawn.empty:
        return ss.sparkSession.createDataFrame([], schema + ", rank int")
    index = fit_cells(S._stack(drawn["v"]), cells, k, recall)
    if see is not None:
        ss, qs = see.mark(ss), see.of(qs).withColumn("_class", F.when(F.col("_all"), EVERYTHING).otherwise(
            F.col("_class"))).drop("_all")

    def placed(df: DataFrame, probes: int) -> DataFrame:
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(cells=list(index.nearest(S._stack(b["v"]), probes).astype(np.int32)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return store(df.mapInPandas(assign, kinds + ", cells array<int>").withColumn("cell", F.explode("cells")).drop("cells"))

    left, right = placed(ss, 1), placed(qs, index.probes)
    blocks = lambda df, rows, name: df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("long").alias(name))
    sizes = F.broadcast(blocks(left, block_rows, "_sb").join(blocks(right, block_queries, "_qb"), "cell"))   # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(sizes, "cell").withColumn("sb", F.pmod(F.xxhash64("section_id"), "_sb")).withColumn(
        "qb", every("_qb")).drop("_sb", "_qb")
    right = right.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), "_qb")).withColumn(
        "sb", every("_sb")).drop("_sb", "_qb")

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "section_id": [], "doc_id": [], "score": []})
        classes = b["_class"].to_numpy() if "_class" in b else None
        return S._best_seen(a, S._stack(b["v"]), b["query_id"].to_numpy(), classes, k)[
            ["query_id", "section_id", "doc_id", "score"]]
    keys = ["cell", "sb", "qb"]
    return top_k(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(multiply, schema), k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per question: how many hits the exact search has, and how many of these were found (equal scores count as equal)."""
    least = exact.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.min("score").alias("_least"))
    return least.join(found, "query_id", "left").groupBy("query_id", "n_exact").agg(
        F.count(F.when(F.col("score") >= F.col("_least"), 1)).alias("n_found"))
