"""Evidence selection inside a section: units, scores, spans, blocks, snippets.

A section is bounded by the sectioning limits, so selection runs inside the row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions.hof import let, one_of
from lectern.functions.text import WS, fold_case, is_digits, normalize_text, strip, tokenize, truncate, uniq

SPANS = "array<struct<a:int,b:int>>"


def _alignment_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(tokenize(c), lambda t: ~one_of(t, fixed.ALIGNMENT_IGNORED_TOKENS)))


def topic_alignment(topics: Column, tags: Column) -> Column:
    """Best pair of a topic and a tag: 1.0 equal, 0.82 contained, else the token ratio (0.72 if covered)."""
    prepared = lambda arr: F.transform(arr, lambda x: F.struct(
        normalize_text(x).alias("n"), _alignment_tokens(x).alias("t")))

    def pair(a, b):
        def ratio(o):
            small, large = F.least(F.size(a["t"]), F.size(b["t"])), F.greatest(F.size(a["t"]), F.size(b["t"]))
            return F.when(o == 0, F.lit(0.0)).when(o == small, F.greatest(o / large, F.lit(0.72))).otherwise(o / large)
        both = (a["n"] != "") & (b["n"] != "")
        return (F.when(both & (a["n"] == b["n"]), F.lit(1.0))
                .when(both & (a["n"].contains(b["n"]) | b["n"].contains(a["n"])), F.lit(0.82))
                .otherwise(let(F.size(F.array_intersect(a["t"], b["t"])), ratio)))
    return let(F.struct(prepared(topics).alias("a"), prepared(tags).alias("b")), lambda v: F.coalesce(F.array_max(
        F.flatten(F.transform(v["a"], lambda a: F.transform(v["b"], lambda b: pair(a, b))))), F.lit(0.0)))


def evidence_units(text: Column) -> Column:
    """Paragraphs; short-line or bulleted paragraphs by line; else sentences; else lines."""
    lines_of = lambda t: F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")

    def units(t):
        chunks = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda x: x != "")
        split = F.flatten(F.transform(chunks, lambda c: let(lines_of(c), lambda ls: F.when(
            ((F.size(ls) >= 2) & F.forall(ls, lambda x: F.length(x) <= 180))
            | F.exists(ls, lambda x: x.rlike(r"^[-*•]|^\d+[\.\)]\s+")), ls).otherwise(F.array(c)))))
        sentences = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), strip), lambda x: x != "")
        return let(split, lambda u: F.when(F.size(u) > 1, u).otherwise(let(sentences, lambda s: F.when(
            F.size(s) > 1, s).otherwise(let(lines_of(t), lambda ls: F.when(
                F.size(ls) > 1, ls).otherwise(F.array(t)))))))
    return let(strip(F.translate(text, "\r", "\n")), lambda t: F.when(
        t == "", F.array().cast("array<string>")).otherwise(units(t)))


def score_unit(unit: Column, focus: Column, expanded: Column, bonus: Column) -> Column:
    """G14 for one unit: focus terms 2.0/0.8, other expanded terms 1.2/0.35, 0.9 · precise match, bonus.

    Rounded to nine places: equal scores stay equal in whatever order they were added up, and the first unit wins.
    """
    def score(n):
        phrase = lambda t: F.translate(t, "_", " ")
        hit = lambda t: (phrase(t) != "") & n.contains(phrase(t))
        add = lambda terms, pair, single: F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(hit(t), F.when(
            t.contains("_"), pair).otherwise(single)).otherwise(0.0))
        precise = F.least(F.lit(3.0), F.aggregate(focus, F.lit(0.0), lambda a, t: a + F.when(hit(t), F.when(
            t.contains("_") | F.exists(F.split(t, "_"), is_digits), 1.0).when(F.length(t) >= 3, 0.5).otherwise(0.0)
        ).otherwise(0.0)))
        others = F.filter(expanded, lambda t: ~F.array_contains(focus, t))
        return F.when(n == "", 0.0).otherwise(F.round(
            add(focus, 2.0, 0.8) + add(others, 1.2, 0.35) + 0.9 * precise + bonus, 9))
    return let(normalize_text(unit), score)


def unit_bonus(section_type: Column, expected: Column, alignment: Column) -> Column:
    """0.35 for an expected section type and 0.45 · topic alignment."""
    return F.when(F.array_contains(expected, section_type), 0.35).otherwise(0.0) + 0.45 * alignment


def evidence_spans(scores: Column, neighbours: int, limit: Column) -> Column:
    """Spans around the best units, not overlapping, up to ``limit``, touching ones merged.

    ``scores``: array of unit scores.  Result: array<struct<a, b>> of 1-based unit positions.
    """
    ranked = F.sort_array(F.filter(F.transform(scores, lambda s, i: F.struct(
        (-s).alias("s"), (i + 1).alias("i"))), lambda x: x["s"] < 0))

    def take(acc, x):
        a = F.greatest(F.lit(1), x["i"] - neighbours).cast("int")
        b = F.least(F.size(scores), x["i"] + neighbours).cast("int")
        clash = F.exists(acc, lambda o: (b >= o["a"]) & (a <= o["b"]))
        return F.when((F.size(acc) >= limit) | clash, acc).otherwise(F.concat(acc, F.array(F.struct(
            a.alias("a"), b.alias("b"))).cast(SPANS)))
    chosen = F.sort_array(F.aggregate(ranked, F.array().cast(SPANS), take))

    def merge(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        return F.when((F.size(acc) > 0) & (x["a"] <= last["b"] + 1), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined).cast(SPANS))).otherwise(
            F.concat(acc, F.array(x).cast(SPANS)))
    return F.aggregate(chosen, F.array().cast(SPANS), merge)


def block_limit(multi: Column, preset: str = "high") -> Column:
    p = fixed.PRESETS[preset]
    return F.when(multi, max(p["blocks_broad"], 2)).otherwise(max(p["blocks_exact"], 1))


def char_limit(multi: Column, exact: Column, preset: str = "high") -> Column:
    p = fixed.PRESETS[preset]
    broad = max(p["broad_chars"], p["chunk_chars"])
    return F.when(multi, broad).when(exact, max(p["exact_chars"], p["small_text"])).otherwise(broad)


def cut(c: Column, limit: Column) -> Column:
    """B24 with a limit per row."""
    return let(strip(F.regexp_replace(c, WS + "+", " ")), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(
        F.regexp_replace(F.substring(t, F.lit(1), limit - 3), WS + r"+\z", ""), F.lit("..."))))


def evidence_blocks(text: str = "body", preset: str = "high", limit: int | None = None,
                    alignment: Column | None = None) -> Column:
    """The whole text when short, else the merged spans, else the truncated text.

    Reads the candidate row's columns: focus_terms, expanded_terms, expected_section_types,
    section_type, topic_hints, metadata_tags, multi_doc_expected, exact_match_expected.
    """
    p, c = fixed.PRESETS[preset], F.col
    chars = char_limit(c("multi_doc_expected"), c("exact_match_expected"), preset)
    most = F.lit(limit) if limit else block_limit(c("multi_doc_expected"), preset)
    aligned = alignment if alignment is not None else topic_alignment(c("topic_hints"), c("metadata_tags"))
    extra = unit_bonus(c("section_type"), c("expected_section_types"), aligned)
    terms = F.struct(uniq(c("focus_terms")).alias("f"), uniq(F.when(F.size("expanded_terms") > 0, c(
        "expanded_terms")).otherwise(c("focus_terms"))).alias("e"), extra.alias("x"))

    def select(t, units):
        scores = let(terms, lambda v: F.transform(units, lambda u: score_unit(u, v["f"], v["e"], v["x"])))
        spans = let(scores, lambda s: evidence_spans(s, p["neighbours"], most))
        blocks = F.filter(F.transform(spans, lambda s: cut(F.array_join(F.slice(
            units, s["a"], s["b"] - s["a"] + 1), "\n"), chars)), lambda b: b != "")
        return let(blocks, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(cut(t, chars))))
    return let(strip(c(text)), lambda t: F.when(t == "", F.array().cast("array<string>")).when(
        F.length(t) <= F.least(F.lit(p["small_text"]), chars), F.array(t)).otherwise(
        let(evidence_units(t), lambda u: select(t, u))))


def snippets(blocks: Column, n: int = 3, chars: int = 320) -> Column:
    """G17."""
    return F.transform(F.slice(blocks, 1, n), lambda b: truncate(b, chars))


def block_key(c: Column) -> Column:
    return fold_case(strip(F.regexp_replace(c, WS + "+", " ")))


def dedup_evidence(blocks: DataFrame) -> DataFrame:
    """blocks(query_id, rank, pos, block): first occurrence of equal text per question."""
    cols = [c for c in blocks.columns if c != "query_id"]
    return blocks.withColumn("_k", block_key(F.col("block"))).groupBy("query_id", "_k").agg(F.min_by(
        F.struct(*cols), F.struct("rank", "pos")).alias("b")).select("query_id", "b.*")


def aliases(hits: DataFrame) -> DataFrame:
    """D1, D2… by first appearance of the document, S1… by appearance inside it."""
    per_doc = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    first = hits.withColumn("_s", F.row_number().over(per_doc)).withColumn("_f", F.min("rank").over(
        Window.partitionBy("query_id", "doc_id")))
    by_first = Window.partitionBy("query_id").orderBy("_f")
    return first.withColumn("doc_alias", F.concat(F.lit("D"), F.dense_rank().over(by_first))).withColumn(
        "section_alias", F.concat(F.lit("S"), F.col("_s"))).drop("_s", "_f")


def document_limit(intents: Column, exact: Column, context: Column, multi: Column) -> Column:
    """Documents described per question by class."""
    return F.when(exact | context, 0).when(F.array_contains(intents, "document_lookup"), 2).when(multi, 3).otherwise(1)
