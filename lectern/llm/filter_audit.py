"""Audit of how document filters interact: decision diagrams over failure masks, reordered by adjacent level swaps."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import Scratch

BLANKS = r"[\x20\x09-\x0D]+"


def text_words(text: Column) -> Column:
    """Maximal runs of characters that are not blank."""
    return F.array_remove(F.split(text, BLANKS), "")


#: Each filter's failure condition, from a text and its words.
FILTERS: Mapping[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"
COUNTS = ("n", "good", "toxic")
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


class Diagram:
    """A decision diagram over failure masks; every node carries the summed counts of the masks below it.

    Level k branches on the k-th filter of the present order, to `low` where a document passes and to `high` where it
    fails.  Equal nodes of a level are one node, so a swap touches no more than two levels of shared nodes.
    """

    def __init__(self, names: str, masks: np.ndarray, counts: np.ndarray):
        """masks: bit k is set where the k-th filter fails; counts: a row of counts for each mask."""
        n = len(names)
        self.order = list(names)
        bits = np.zeros(len(masks), np.int64)
        for k in range(n):                                                # the first filter becomes the highest bit
            bits |= ((masks.astype(np.int64) >> k) & 1) << (n - 1 - k)
        leaves = np.zeros((1 << n, counts.shape[1]), np.int64)
        np.add.at(leaves, bits, counts)
        weight, at = np.unique(leaves, axis=0, return_inverse=True)
        self.low, self.high, self.weight = [np.empty(0, int)] * n, [np.empty(0, int)] * n, [weight] * (n + 1)
        at = at.ravel()
        for k in reversed(range(n)):
            self.low[k], self.high[k], at = self._shared(at[0::2], at[1::2])
            self._weigh(k)

    @staticmethod
    def _shared(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
        return nodes[:, 0], nodes[:, 1], at.ravel()

    def _weigh(self, k: int) -> None:
        self.weight[k] = self.weight[k + 1][self.low[k]] + self.weight[k + 1][self.high[k]]

    def swap(self, k: int) -> None:
        """Exchange the filters of levels k and k + 1: the four grandchildren of each upper node are paired anew."""
        below = self.low[k + 1], self.high[k + 1]
        pass_pass, pass_fail = (side[self.low[k]] for side in below)
        fail_pass, fail_fail = (side[self.high[k]] for side in below)
        m = len(pass_pass)
        self.low[k + 1], self.high[k + 1], at = self._shared(
            np.concatenate([pass_pass, pass_fail]), np.concatenate([fail_pass, fail_fail]))
        self._weigh(k + 1)
        self.low[k], self.high[k] = at[:m], at[m:]
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Along the path on which everything passes: each filter, the counts it keeps and those it removes."""
        node = 0
        for k, name in enumerate(self.order):
            removed = self.weight[k + 1][self.high[k][node]]
            node = self.low[k][node]
            yield name, self.weight[k + 1][node], removed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions k whose exchange with k + 1, one after another, leads through all n! orders, each once."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    sweeps = [range(n - 2, -1, -1), range(n - 1)]
    down = 0
    while True:
        yield from sweeps[down % 2]                 # the last element passes through the order of the others
        step = next(inner, None)
        down += 1
        if step is None:
            return
        yield step + down % 2                       # the others move on by one exchange while it waits at an end


def audit_part(names: str, masks: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows (filter_order, step, ...) of every order, from the mask counts of one part."""
    diagram = Diagram(names, masks, counts)
    bit = {name: 1 << k for k, name in enumerate(names)}
    fails = {name: int(counts[(masks & b) != 0, 0].sum()) for name, b in bit.items()}
    unique = {name: int(counts[masks == b, 0].sum()) for name, b in bit.items()}
    shapley = dict.fromkeys(names, 0)
    rows = []
    for k in (None, *adjacent_swaps(len(names))):
        if k is not None:
            diagram.swap(k)
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            gone = int(removed[0])
            shapley[name] += gone
            rows.append((order, step, name, int(kept[0]), gone, fails[name] - gone, unique[name], int(removed[1]),
                         int(removed[2])))
    return [(order, step, *rest, shapley[name]) for order, step, name, *rest in rows]


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", id: str = "doc_id", text: str = "text",
                filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, copies: str | None = COPIES,
                scratch: Scratch | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail; at most 2^filters rows a part.

    Texts stay in the scan: what travels is a mask, an id and a SHA-256 digest.  Rows alike in all of these are counted
    before they travel, so copies of one text, or repeats of one id, arrive as counts.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    body, words = F.col("_text"), F.col("_words")
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(body, words), 1 << k).otherwise(0)
    rows = (docs.select(F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[id].alias("id"),
                        F.coalesce(docs[text], F.lit("")).alias("_text"))
            .select("part", "id", "_text", text_words(body).alias("_words"))
            .select("part", "id", mask.alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest")))
    seen = scratch.store(rows.groupBy("part", "id", "mask", "digest").agg(F.count("*").alias("n")))
    yes = lambda c: F.max(F.when(labels[c] == 1, 1).otherwise(0))
    known = (labels.filter(labels[id].isNotNull()).groupBy(labels[id].alias("id"))
             .agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).filter("good + toxic > 0"))
    named = seen.filter("id is not null").join(known, "id", "left").fillna(0, ["good", "toxic"])
    nameless = seen.filter("id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    alike = named.unionByName(nameless).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))        # a few rows a digest: parts and labels
    alike = alike.withColumn("first", first).withColumn(
        "alone", F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    if copies is None:
        split = F.array(F.struct("mask", F.col("n").alias("k")))
    else:
        split = F.array(F.struct("mask", F.col("alone").alias("k")),
                        F.struct((F.col("mask") + (1 << len(filters))).alias("mask"),
                                 (F.col("n") - F.col("alone")).alias("k")))
    return (alike.select("part", "good", "toxic", F.inline(split)).groupBy("part", "mask")
            .agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"),
                 F.sum(F.col("k") * F.col("toxic")).alias("toxic")))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", id: str = "doc_id", text: str = "text",
                  filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, copies: str | None = COPIES,
                  scratch: Scratch | None = None) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    A part's documents are counted by failure mask; a task builds the part's decision diagram from at most 2^filters
    counts, walks through all orders by exchanging adjacent levels, and reads each order's steps off the path on which
    everything passes.  `filters` give failure conditions by one-letter name; `copies` names the last one, which fails
    a document whose text stands under a smaller id anywhere in the table.  All orders are reported, so the filters
    together are at most eight.

    Null texts count as empty (they fail few-words filters, and copies of each other), a null part is the empty string.
    A null id has no order: it neither fails as a copy nor makes a copy.  Equal ids are not smaller than each other, so
    repeated rows pass or fail together.  A document counts as good or toxic if any label row of its id says so.  An
    empty table gives no rows; texts are read whole; other columns are not read.
    """
    names = "".join(filters) + (copies or "")
    if len(names) > 8 or len(set(names)) < len(names):
        raise ValueError("up to eight filters with distinct one-letter names")
    counts = mask_counts(docs, labels, part, id, text, filters, copies, scratch)

    def report(group: pd.DataFrame) -> pd.DataFrame:
        rows = audit_part(names, group["mask"].to_numpy(), group[list(COUNTS)].to_numpy(np.int64))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")[1:]])
        out.insert(0, "part", group["part"].iloc[0])
        return out

    assert math.factorial(len(names)) <= 40320
    return counts.groupBy("part").applyInPandas(report, RESULT)


def oracle() -> str:
    """DuckDB SQL for the five standard filters over `documents` and `labels`: every order from the masks directly."""
    blank = r"[^\x20\x09-\x0D]+"
    letters = "abcde"
    pick = " || ".join(f"{x}.l" for x in letters)
    bits = ", ".join(f"{x}.b" for x in letters)
    apart = " and ".join(f"{x}.b <> {y}.b" for i, x in enumerate(letters) for y in letters[:i])
    return f"""
with d0 as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
d1 as (select *, regexp_extract_all(t, '{blank}') as w,
       coalesce(min(doc_id) over (partition by t) < doc_id, false) as e from d0),
d2 as (select part, doc_id, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
       + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
       + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * e::int as mask from d1),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic
      from labels where doc_id is not null group by 1),
m as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
      from d2 left join l on l.doc_id = d2.doc_id group by 1, 2),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as f(l, b)),
o as (select {pick} as filter_order, [{bits}] as bits from {", ".join(f"f {x}" for x in letters)} where {apart}),
s as (select filter_order, step, bits[step] as b, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
      from o cross join (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, b,
      coalesce(sum(n) filter (where mask & (before + b) = 0), 0) as kept,
      coalesce(sum(n) filter (where mask & before = 0 and mask & b <> 0), 0) as removed,
      coalesce(sum(n) filter (where mask & before <> 0 and mask & b <> 0), 0) as redundant,
      coalesce(sum(n) filter (where mask = b), 0) as unique_fails,
      coalesce(sum(good) filter (where mask & before = 0 and mask & b <> 0), 0) as good_lost,
      coalesce(sum(toxic) filter (where mask & before = 0 and mask & b <> 0), 0) as toxic_lost
      from m cross join s group by 1, 2, 3, 4)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, b))::bigint as shapley
from r"""
