"""Quality scores learned from preference pairs (Bradley-Terry)."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANK, Scratch, pieces, words

NAMES = ("length", "distinct", "symbols", "adjacent", "word_length", "marks", "digits", "upper", "top_word", "lines",
         "repeated_pairs", "high_bytes", "short_words", "long_words", "capital_words", "line_ends")
CUTS = 8


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES per text, from whole texts; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(NAMES)))
    at = {name: k for k, name in enumerate(NAMES)}
    of = np.repeat(np.arange(n), np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=n) / np.maximum(size, 1)

    digit = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    mark = np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    out[:, at["digits"]], out[:, at["upper"]], out[:, at["marks"]] = share(digit), share(upper), share(mark)
    out[:, at["high_bytes"]] = share(data >= 128)
    out[:, at["symbols"]] = share(~(digit | letter | mark | BLANK[data]))
    word, row, start, end = words(data, offsets)
    count = np.bincount(row, minlength=n).astype(float)
    many = np.maximum(count, 1)
    length = end - start
    out[:, at["length"]] = np.log1p(count)
    out[:, at["word_length"]] = np.bincount(row, length, n) / many
    out[:, at["short_words"]] = np.bincount(row[length <= 2], minlength=n) / many
    out[:, at["long_words"]] = np.bincount(row[length >= 15], minlength=n) / many
    out[:, at["capital_words"]] = np.bincount(row[upper[start]], minlength=n) / many

    def spread(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys per row, and how often the commonest stands."""
        if not len(key):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((key, of))
        k, r = key[order], of[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        first = np.flatnonzero(new)
        times = np.diff(np.concatenate([first, [len(k)]]))
        top = np.zeros(n)
        np.maximum.at(top, r[first], times)
        return np.bincount(r[first], minlength=n).astype(float), top

    kinds, top = spread(word, row)
    out[:, at["distinct"]] = np.where(count > 0, kinds / many, 0)
    out[:, at["top_word"]] = top / many
    beside = row[1:] == row[:-1]
    out[:, at["adjacent"]] = np.bincount(row[1:][beside & (word[1:] == word[:-1])], minlength=n) / many
    pair = (word[:-1] * np.uint64(3) + word[1:])[beside]
    kinds, _ = spread(pair, row[1:][beside])
    pairs = np.bincount(row[1:][beside], minlength=n)
    out[:, at["repeated_pairs"]] = np.where(pairs > 0, 1 - kinds / np.maximum(pairs, 1), 0)
    stop = np.zeros(256, bool)
    stop[10] = True
    line, of_line, _, _ = words(data, offsets, stop)
    lines = np.bincount(of_line, minlength=n)
    kinds, _ = spread(line, of_line)
    out[:, at["lines"]] = np.where(lines > 0, 1 - kinds / np.maximum(lines, 1), 0)
    out[:, at["line_ends"]] = lines / many
    return out


@dataclass(frozen=True)
class Ranker:
    """Strength of a document: weights on its features and on steps over their cut points."""
    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, (x[:, :, None] > self.cuts[None]).reshape(len(x), -1)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 60_000, penalty: float = 1e-3, seed: int = 7) -> Ranker:
    """Logistic loss on feature differences of pairs (a good one preferred to a bad one), by Newton steps.

    Without rows of both kinds every document gets the same strength.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    cuts = (np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1], axis=0).T if len(x) else np.zeros((len(NAMES), CUTS)))
    model = Ranker(mean, scale, cuts, np.zeros(len(NAMES) * (1 + CUTS)))
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return model
    rng = np.random.default_rng(seed)
    e = model.expand(x)
    diff = e[rng.choice(a, pairs)] - e[rng.choice(b, pairs)]
    w = np.zeros(diff.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(0) + penalty * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + penalty * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(mean, scale, cuts, w)


def quantile_threshold(labelled: DataFrame) -> float:
    """Where the strengths of all rows (strength, good) are parted at the share of bad ones: midway between two of them.

    The quantile is Spark's, its rank right to a millionth of the rows.  Without rows of both kinds it is 0.
    """
    n, bad = labelled.agg(F.count("*"), F.count_if(~F.col("good"))).first()
    if not 0 < bad < n:
        return 0.0
    below = labelled.agg(F.percentile_approx("strength", bad / n, 1_000_000)).first()[0]
    above = labelled.filter(F.col("strength") > below).agg(F.min("strength")).first()[0]
    return below if above is None else (below + above) / 2


def score_quality(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
                  accept: float = 0.3, most_rows: int = 20_000, folds: int = 5,
                  scratch: Scratch | None = None) -> DataFrame:
    """Per row: whether it is held out, its score, and whether it is accepted (score >= `accept`).

    Scores use the text alone.  Learned from labelled rows whose crc32(id as text) is not divisible by `folds`; of
    these the weights are fitted on at most `most_rows`, those with the smallest hash of their id, so the sample is spread
    over the table and the fit stays bounded; the threshold is a quantile over the strengths of all of them.  Features are computed once for all rows and stored.  Null labels teach nothing; a null
    text counts as empty and gets a score; ids that repeat or are null stay, a null id is not held out; an empty
    table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in pieces(batches):
            x = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), fixed(x)], ["doc_id", "x"])

    measured = scratch.store(rows.mapInArrow(measure, f"doc_id {kind}, x array<double>"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.select(labels[id].alias("doc_id"), labels[label].alias("_label")).dropna().filter(fold != 0)
    taught = (measured.join(known, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
              .orderBy("_h", "doc_id", "_label", F.col("x")).limit(most_rows).select("x", "_label").toArrow())
    x = np.array(taught.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    model = fit_pairs(x, np.array(taught.column("_label").to_pylist()) == 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.strength(x), pa.float64())], ["doc_id", "strength"])

    judged = scratch.store(measured.mapInArrow(judge, f"doc_id {kind}, strength double"))
    at = quantile_threshold(scratch.store(judged.join(known, "doc_id").select("strength", (F.col("_label") == 1).alias("good"))))
    lift = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("strength") - at + math.log(accept / (1 - accept))))
    scored = judged.select("doc_id", (1 / (1 + F.exp(-lift))).alias("score"))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= accept).cast("int").alias("predicted"))


def fixed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
