"""Mixing sources to target weights that change over the course of training."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import Scratch
from lectern.llm.filter_audit import text_words

Knots = Sequence[tuple[float, float]]

#: Weight over training time (0 to 1), linear between knots; sources in order of their names take these in turn.
#: Their integrals are 3, 1 and 2.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 2.0), (1.0, 4.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)),
)


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def pieces_of(knots: Knots) -> Column:
    """The linear pieces of a schedule with the area before each."""
    made, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        made.append(F.struct(F.lit(t0).alias("t"), F.lit(area).alias("area"), F.lit(w0).alias("w"),
                             F.lit((w1 - w0) / (t1 - t0)).alias("slope")))
        area += (t1 - t0) * (w0 + w1) / 2
    return F.array(*made)


def when_reached(schedules: Sequence[Knots], kind: Column, share: Column) -> Column:
    """The time at which a source's integrated weight reaches a share of its whole: each piece's square inverted."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        need = share * integral(knots)
        piece = F.element_at(F.filter(pieces_of(knots), lambda p: p["area"] <= need), -1)
        left = need - piece["area"]
        root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["slope"] * left, F.lit(0.0)))
        time = piece["t"] + F.when(left > 0, 2 * left / (piece["w"] + root)).otherwise(0.0)
        out = F.when(kind == k, time).otherwise(out)
    return out


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: str, name: str,
            scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows in shards by range of (group, order) with the sum of `amount` before each row of its shard and group,
    and a table (shard, group, offset, total): the sum before the shard, and of the shard.

    A group of any size is cut into shards; no task sees more than one.  The shard is stored as a column, so that later
    reads agree on it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = scratch.store(df.repartitionByRange(n, *group, *order).withColumn("shard", F.spark_partition_id()))
    inner = Window.partitionBy("shard", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.withColumn(name, F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    sums = shards.groupBy("shard", *group).agg(F.sum(amount).alias("total"))
    outer = Window.partitionBy(*group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return rows, sums.withColumn("offset", F.coalesce(F.sum("total").over(outer), F.lit(0)))


def targets(sources: DataFrame, budget: float, repeats: int, scratch: Scratch) -> DataFrame:
    """`sources` (weight, total) with `target`: shares of budget * all sizes by weight, none above repeats * total.

    The level at which weight * level meets the budget rises round by round as more sources reach their limit; each
    round sends four sums to the driver.
    """
    sources = scratch.store(sources)
    limit, level, held = F.col("total") * repeats, 0.0, -1
    whole = (sources.agg(F.sum("total")).first()[0] or 0) * budget
    while True:
        full = F.col("weight") * level > limit
        n, taken, weight = sources.agg(F.count(F.when(full, 1)), F.sum(F.when(full, limit)),
                                       F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not weight:
            break
        held, level = n, (whole - (taken or 0)) / weight
    rest = F.lit(0.0) if not weight else F.col("weight") * F.lit(float(whole - (taken or 0))) / F.lit(float(weight))
    return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(rest))


def mix_sources(df: DataFrame, schedules: Sequence[Knots] = SCHEDULES, budget: float = 1.5, repeats: int = 2,
                id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (),
                scratch: Scratch | None = None) -> DataFrame:
    """One row per document: its size in words, its source's size and target, what the mix takes, and its copies.

    Targets are the integrals of the sources' weight schedules (sources by code point, null last, take `schedules` in
    turn), scaled to `budget` times all sizes and stopped at `repeats` times a source's size.  A source's documents
    stand in a fixed pseudo-random order (MD5 of the id) and are read over and over until round(target) words are
    taken; the last one is cut, so a source takes exactly that many.  `copies` has one entry for each time a document is read:
    the round, the words taken from its start, and its position, the time in 0 to 1 at which the source's cumulative
    demand reaches the copy's first word.  `position` is the first copy's; rows come range-sorted by it, documents that
    are not taken last.  `keep` names further columns to carry along, such as the text.

    Null texts and texts without words have size 0 and no copies.  Null and repeated ids are rows like others: ties of
    the id are ordered by a hash of the text, rows alike in both in any order, which changes no set of results.  An
    empty table gives no rows.  Other columns are not read.
    """
    if any(w < 0 for k in schedules for _, w in k) or any(integral(k) <= 0 for k in schedules):
        raise ValueError("weights must not be negative, and each schedule needs some weight")
    scratch = scratch or Scratch(df.sparkSession)
    body = F.coalesce(df[text], F.lit(""))
    named = F.coalesce(df[source].cast("string"), F.lit(""))
    rows = scratch.store(df.select(
        df[id].alias("doc_id"), F.size(text_words(body)).cast("long").alias("size"), df[source].isNull().alias("_none"),
        named.alias("_source"), F.md5(F.coalesce(df[id].cast("string"), F.lit("")).cast("binary")).alias("_key"),
        F.xxhash64(body).alias("_text"), F.rand(11).alias("_any"), *(df[c].alias(f"_keep_{c}") for c in keep)))
    group = ["_none", "_source"]
    sums = rows.groupBy(*group).agg(F.sum("size").alias("total")).withColumn("one", F.lit(1))
    ranked, before = running(sums, (), group, "one", "_rank", scratch)
    kind = ((F.col("_rank") + F.col("offset")) % len(schedules)).cast("int")
    ranked = (ranked.join(before.select("shard", "offset"), "shard").select(*group, "total", kind.alias("kind"))
              .withColumn("weight", F.element_at(F.array(*(F.lit(integral(k)) for k in schedules)), F.col("kind") + 1)))
    aims = targets(ranked, budget, repeats, scratch).select(
        *group, "kind", F.col("total").alias("source_size"), "target")
    placed, offsets = running(rows, group, ["_key", "doc_id", "_text", "_any"], "size", "_before", scratch)
    offsets = offsets.drop("total").join(aims, group)
    start = F.col("_before") + F.col("offset")
    want = F.floor(F.col("target") + 0.5)

    def copy(k: Column) -> Column:
        begin = (k - 1) * F.col("source_size") + start
        words = F.greatest(F.least(want - begin, F.col("size")), F.lit(0))
        share = begin / F.greatest(want, F.lit(1)).cast("double")
        return F.struct(k.cast("int").alias("round"), words.cast("long").alias("words"),
                        F.when(words > 0, when_reached(schedules, F.col("kind"), share)).alias("position"))

    made = placed.join(offsets, ["shard", *group]).withColumn("copies", F.filter(
        F.transform(F.array(*(F.lit(k).cast("long") for k in range(1, repeats + 1))), copy), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    out = made.select(
        "doc_id", "size", F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size", "target",
        taken.alias("taken"), F.when(F.size("copies") > 0, F.col("copies")[0]["position"]).alias("position"), "copies",
        *(F.col(f"_keep_{c}").alias(c) for c in keep), "_key", "_any")
    return out.orderBy(F.col("position").asc_nulls_last(), "_key", "_any").drop("_key", "_any")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy in training order: the columns of `mix_sources`, with each copy's round, words and position."""
    rest = [c for c in mixed.columns if c not in ("copies", "position", "taken")]
    return mixed.select(*rest, F.inline("copies")).orderBy("position")


def oracle() -> str:
    """DuckDB SQL for the standard schedules over `documents`."""
    def time(knots: Knots) -> str:
        out, area = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            slope = (w1 - w0) / (t1 - t0)
            left = f"(share * {integral(knots)} - {area})"
            out.insert(0, f"when share * {integral(knots)} >= {area} then {t0} + case when {left} > 0 then 2 * {left} / "
                          f"({w0} + sqrt(greatest({w0 * w0} + 2 * {slope} * {left}, 0))) else 0 end")
            area += (t1 - t0) * (w0 + w1) / 2
        return f"case {' '.join(out)} end"
    kinds = " ".join(f"when {k} then {time(knots)}" for k, knots in enumerate(SCHEDULES))
    weight = " ".join(f"when {k} then {integral(knots)}" for k, knots in enumerate(SCHEDULES))
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
s as (select source, sum(size)::double as total,
      (row_number() over (order by source nulls last) - 1) % {len(SCHEDULES)} as kind from d group by 1),
w as (select *, (case kind {weight} end)::double as weight, total * 2 as cap from s),
o as (select *, row_number() over (order by cap / weight, source nulls last) as k,
      coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
      sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rest,
      sum(total) over () * 1.5 as whole from w),
cut as (select min(k) as k from o where (whole - before) / rest * weight <= cap),
level as (select whole - before as words, rest from o join cut on o.k = cut.k),
t as (select o.source, o.total, o.kind, case when o.k < cut.k then cap else weight * words / level.rest end as target
      from o cross join cut cross join level),
p as (select d.doc_id, d.size, t.source, t.total, t.kind, t.target, floor(t.target + 0.5)::bigint as want,
      coalesce(sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '')), d.doc_id
               rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join t on d.source is not distinct from t.source),
c as (select *, greatest(least(want - start, size), 0) as first_words,
      greatest(least(want - start - total::bigint, size), 0) as second_words,
      start / greatest(want, 1)::double as share from p)
select doc_id, size::bigint as size, source, total::bigint as source_size, target::double as target,
       (first_words + second_words)::bigint as taken,
       case when first_words > 0 then round(case kind {kinds} end, 9) end as position,
       ((first_words > 0)::int + (second_words > 0)::int)::int as n_copies
from c"""
