"""License scans: a positional index of rare words, looked up and verified inside each row."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A key phrase, the label it stands for, and whether it is a base one."""
    phrase: str
    label: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


BASE = (
    Template("mit license", "mit", True),
    Template("apache license", "apache", True),
    Template("general public license", "gpl", True),
)
MORE = (
    Template("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Template("licensed under the apache license version 2", "apache-2"),
    Template("gnu general public license version 2", "gpl-2"),
    Template("gnu general public license version 3", "gpl-3"),
    Template("lesser general public license", "lgpl"),
    Template("affero general public license", "agpl"),
    Template("redistribution and use in source and binary forms", "bsd"),
    Template("bsd license", "bsd"),
    Template("mozilla public license", "mpl"),
    Template("eclipse public license", "epl"),
    Template("boost software license", "bsl"),
    Template("isc license", "isc"),
    Template("creative commons", "cc"),
    Template("cc by", "cc-by"),
    Template("cc by sa", "cc-by-sa"),
    Template("cc by nc", "cc-by-nc"),
    Template("all rights reserved", "reserved"),
)


def words_of(text: Column) -> Column:
    """Words of a whole text with A-Z lower-cased; null counts as empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def idf(df: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF over all rows of the templates' words: only these words are counted, so what is collected is bounded."""
    vocabulary = sorted({w for t in templates for w in t.words})
    own = F.array_append(F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary))), "")
    count = {r["word"]: r["n"] for r in df.select(F.explode(own).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")).collect()}
    return {w: math.log((count.get("", 0) + 1) / (count.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(df: DataFrame, id: str = "doc_id", text: str = "text",
                  templates: tuple[Template, ...] = BASE + MORE) -> DataFrame:
    """Per row: words, base places with the first and last start, labels, and a score.

    Each template is posted under its rarest word (highest IDF over the table, ties by spelling) with that word's
    offset.  A row's licence words are looked up in these postings, a hit gives a template and a start by relative
    position, and the phrase is verified from there; so every place is found once.  All of it happens inside the row,
    in array functions: no shuffle but for the IDF counts.  The score is s / (s + 10), s being the summed IDF of the words
    of the distinct templates found.  Null texts count as empty (no words, null starts, empty labels, score 0); each row
    gives one row, repeated and null ids included; an empty table gives none; other columns are not read.
    """
    weight = idf(df.select(text), text, templates)
    rows = df.select(df[id].alias("doc_id"), words_of(df[text]).alias("w"))
    anchors: dict[str, list[Column]] = {}
    for k, t in enumerate(templates):
        words = t.words
        rare = max(words, key=lambda w: (weight[w], w))
        anchors.setdefault(rare, []).append(F.struct(
            F.lit(k).alias("k"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
            F.lit(words.index(rare)).alias("offset"), F.array(*map(F.lit, words)).alias("words"),
            F.lit(sum(weight[w] for w in words)).alias("weight")))
    rare_words = sorted(anchors)
    posted = F.create_map(*(x for w in rare_words for x in (F.lit(w), F.array(*anchors[w]))))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h.w.isin(rare_words))

    def starts(h: Column) -> Column:
        return F.transform(posted[h.w], lambda t: F.struct(
            t.k.alias("k"), t.label.alias("label"), t.base.alias("base"), t.weight.alias("weight"),
            (h.i - t.offset).alias("start"), t.words.alias("words")))

    def verified(c: Column) -> Column:
        return (c.start >= 0) & (F.slice(F.col("w"), F.greatest(c.start, F.lit(0)) + 1, F.size(c.words)) == c.words)

    none = F.expr("cast(array() as array<struct<k:int,label:string,base:boolean,weight:double,start:int,words:array<string>>>)")
    any_hit = F.arrays_overlap("w", F.array(*map(F.lit, rare_words)))
    found = rows.withColumn("n_words", F.size("w").cast("long")).withColumn(
        "f", F.when(any_hit, F.filter(F.flatten(F.transform(hits, starts)), verified)).otherwise(none)).drop("w")
    base = F.filter("f", lambda x: x.base)
    place = F.transform(base, lambda x: x.start.cast("long"))

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.label))), ",")

    kinds = F.array_sort(F.array_distinct(F.transform("f", lambda x: F.struct(x.k.alias("k"), x.weight.alias("weight")))))
    s = F.aggregate(kinds, F.lit(0.0), lambda a, x: a + x.weight)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("f")).alias("labels"),
        F.round(s / (s + 10.0), 9).alias("score"))


def oracle(templates: tuple[Template, ...] = BASE + MORE) -> str:
    """The same rows in the other engine's SQL."""
    values = ", ".join(f"({k}, {t.words!r}, '{t.label}', {t.base})" for k, t in enumerate(templates))
    return f"""
with w as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
t(k, words, label, base) as (values {values}),
u as (select r, i, ws[i] word, ws from (select r, ws, unnest(range(1, len(ws) + 1)) i from w)),
f as (select u.r, u.i - 1 start, t.* from u join t on u.word = t.words[1] and ws[i:i + len(words) - 1] = words),
df as (select word, count(distinct r) n from u group by word),
weights as (select k, sum(ln((select count(*) + 1 from documents)::double / (coalesce(df.n, 0) + 1))) weight
            from (select k, unnest(words) word from t) x left join df using (word) group by k),
s as (select r, sum(weight) s from (select distinct r, k from f) join weights using (k) group by r),
a as (select r, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
        array_to_string(list_sort(list_distinct(list(label) filter (base))), ',') base_labels,
        array_to_string(list_sort(list_distinct(list(label))), ',') labels from f group by r)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word,
  last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  coalesce(round(s / (s + 10.0), 9), 0.0) score
from w left join a using (r) left join s using (r)"""
