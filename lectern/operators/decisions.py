"""Per-question decisions: answerability, confidence, context selection, grounding and routing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions.hof import any_contains, let
from lectern.functions.text import content_kind, fold_case, head, supports, uniq
from lectern.operators.evidence import aliases, dedup_evidence, document_limit, evidence_blocks, topic_alignment
from lectern.operators.rerank import precise_count


def confidence(best: Column, high: float = 0.55, medium: float = 0.38) -> Column:
    """G24."""
    return F.when(best >= high, "High").when(best >= medium, "Medium").otherwise("Low")


def question_confidence(hits: DataFrame, score: str = "score") -> DataFrame:
    return hits.groupBy("query_id").agg(F.max(score).alias("best_score")).withColumn(
        "confidence", confidence(F.col("best_score")))


def support_terms() -> Column:
    """Terms a block must show: focus terms for exact questions, else expanded or focus terms."""
    return uniq(F.when(F.col("exact_match_expected") | (F.size("expanded_terms") == 0), F.col("focus_terms")).otherwise(
        F.col("expanded_terms")))


def answerability(candidates: DataFrame, score: str = "score", min_score: float = 0.24, sure_score: float = 0.50,
                  topic_min: float = 0.55, min_support: int = 1, min_support_multi: int = 2, min_exact: int = 1,
                  lookup_min: float = 0.55, preset: str = "high") -> DataFrame:
    """Whether each question can be answered from its ranked candidates.

    Candidate rows carry the analysis, section columns, rank, score, ``doc_tags``, ``doc_title_terms``
    and, where computed, ``lookup_score`` of their document.  All rules are one aggregate per question
    followed by an ordered ladder; ``reason`` names the rule that decided.
    """
    c = F.col
    rows = candidates.withColumn("_ok", supports(support_terms(), evidence_blocks(preset=preset, limit=2))).withColumn(
        "_n", precise_count(c("focus_terms"), c("section_title"), c("body"))).withColumn(
        "_align", F.greatest(topic_alignment(c("topic_hints"), c("metadata_tags")),
                             topic_alignment(c("topic_hints"), c("doc_tags")))).withColumn(
        "_title", F.size(F.array_intersect(F.array_distinct(F.concat("title_terms", "doc_title_terms")), F.when(
            F.size("expanded_terms") > 0, c("expanded_terms")).otherwise(c("focus_terms")))))
    first = lambda col: F.min_by(col, "rank")
    per = rows.groupBy("query_id").agg(
        first(score).alias("best"), first("_align").alias("align"), first("_title").alias("title_overlap"),
        first(F.size("topic_hints")).alias("topics"), first("lookup_score").alias("lookup"),
        F.bool_or("exact_match_expected").alias("exact"), F.bool_or("multi_doc_expected").alias("multi"),
        F.count_if("_ok").alias("support"), F.count_distinct(F.when(c("_ok"), c("doc_id"))).alias("support_docs"),
        F.count_distinct("doc_id").alias("docs"), F.sum("_n").alias("exact_matches"))
    reason = (F.when(c("lookup") >= lookup_min, "lookup").when(c("best") < min_score, "weak")
              .when(c("best") >= sure_score, "score").when(c("align") >= topic_min, "topic")
              .when(c("support") < min_support, "unsupported")
              .when(c("exact") & (c("exact_matches") < min_exact), "inexact")
              .when(c("multi") & (c("docs") > 1) & (c("support_docs") < min_support_multi), "narrow")
              .when((c("topics") > 0) & (c("align") == 0) & (c("title_overlap") == 0), "off_topic")
              .otherwise("support"))
    return per.withColumn("reason", reason).withColumn("answerable", c("reason").isin(
        "lookup", "score", "topic", "support"))


def dual_candidates(docs: DataFrame, analysis: DataFrame, min_score: float = 0.38, ratio: float = 0.88) -> DataFrame:
    """Questions whose two best documents are close: (query_id, doc_a, doc_b, score_ratio)."""
    two = docs.filter(F.col("doc_rank") <= 2).groupBy("query_id").agg(
        *[F.max(F.when(F.col("doc_rank") == n, F.col(v))).alias(f"{v}_{p}") for n, p in ((1, "a"), (2, "b"))
          for v in ("doc_id", "doc_score")])
    plain = analysis.filter(~F.col("multi_doc_expected") & ~F.col("exact_match_expected")
                            & ~F.col("context_dependent")).select("query_id")
    out = two.join(plain, "query_id").withColumn("score_ratio", F.when(
        F.col("doc_score_a") > 0, F.col("doc_score_b") / F.col("doc_score_a")))
    return out.filter((F.col("doc_score_a") >= min_score) & (F.col("score_ratio") >= ratio)).select(
        "query_id", F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"), "score_ratio")


def dual_sections(duals: DataFrame, hits: DataFrame) -> DataFrame:
    """Sections of either side; without any, places 1-3 and 4-6 stand in."""
    sides = duals.select("query_id", F.explode(F.array(
        F.struct(F.lit("A").alias("side"), F.col("doc_a").alias("side_doc"), F.lit(0).alias("skip")),
        F.struct(F.lit("B").alias("side"), F.col("doc_b").alias("side_doc"), F.lit(3).alias("skip")))).alias("s")
                         ).select("query_id", "s.*")
    rows = sides.join(hits, "query_id").withColumn("own", F.col("doc_id") == F.col("side_doc"))
    rows = rows.withColumn("any_own", F.bool_or("own").over(Window.partitionBy("query_id", "side")))
    return rows.filter(F.when(F.col("any_own"), F.col("own")).otherwise(
        (F.col("rank") > F.col("skip")) & (F.col("rank") <= F.col("skip") + 3))).select(
        "query_id", "side", "section_id", "doc_id", "score", "rank")


# --- context selection ----------------------------------------------------------------
def exact_context(hits: DataFrame, scale: float = 0.65, floor: float = 0.55,
                  noisy: Sequence[str] = fixed.NOISY_MARKERS) -> DataFrame:
    """Sections over max(scale·best, floor), noisy ones only near the best; else the first three.

    The first section that is not noisy always passes the floor.
    """
    best = hits.groupBy("query_id").agg(F.max_by("score", -F.col("rank")).alias("_b"))
    text = fold_case(F.concat_ws(" ", "section_title", F.coalesce("summary", F.lit(""))))
    rows = hits.join(best, "query_id").withColumn("_noisy", (F.col("score") < 0.8 * F.col("_b")) & any_contains(
        text, noisy)).withColumn("_low", F.col("score") < F.when(F.col("_b") == 0, 0.0).otherwise(
            F.greatest(F.lit(scale) * F.col("_b"), F.lit(floor))))
    first = rows.filter(~F.col("_noisy")).groupBy("query_id").agg(F.min("rank").alias("_first"))
    rows = rows.join(first, "query_id", "left")
    keep = ~F.col("_noisy") & (~F.col("_low") | (F.col("rank") == F.col("_first")))
    return rows.filter(F.when(F.col("_first").isNotNull(), keep).otherwise(F.col("rank") <= 3)).drop(
        "_b", "_noisy", "_low", "_first")


def aggregate_signal(title: Column, summary: Column, body: Column, section_type: Column,
                     positive: Sequence[str] = fixed.POSITIVE_MARKERS,
                     negative: Sequence[str] = fixed.NEGATIVE_MARKERS, chars: int | None = None) -> Column:
    """+5 positive marker, +2 component, +1 general type, -6 negative marker."""
    text = fold_case(F.concat_ws(" ", title, summary, head(body, chars)))
    return let(text, lambda t: F.when(any_contains(t, positive), 5).otherwise(0) + F.when(
        t.contains("component"), 2).otherwise(0) + F.when(section_type == "general", 1).otherwise(0) - F.when(
        any_contains(t, negative), 6).otherwise(0))


def aggregate_context(hits: DataFrame, signal: str = "signal") -> DataFrame:
    """By signal and score: first section per document, more of a document from signal 2, then the rest from 1.

    ``selected`` numbers the taken sections.  A document's first section is always taken, so its
    coverage never depends on the signal.
    """
    per_doc = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(signal), F.desc("score"), "rank")
    rows = hits.withColumn("_first", F.row_number().over(per_doc) == 1)
    step = F.when(F.col("_first") | (F.col(signal) >= 2), 1).when(F.col(signal) >= 1, 2)
    order = Window.partitionBy("query_id").orderBy("_step", F.desc(signal), F.desc("score"), "rank")
    return rows.withColumn("_step", step).filter(F.col("_step").isNotNull()).withColumn(
        "selected", F.row_number().over(order)).drop("_first", "_step")


def evidence_table(candidates: DataFrame, preset: str = "high") -> DataFrame:
    """One row per question and evidence block with its tag, title and content kind.

    Candidate rows as for ``answerability``; blocks equal to an earlier one of the question are left out.
    """
    c = F.col
    named = aliases(candidates).withColumn("_blocks", evidence_blocks(preset=preset)).withColumn(
        "kind", content_kind(c("body"))).withColumn("doc_limit", document_limit(
            c("intents"), c("exact_match_expected"), c("context_dependent"), c("multi_doc_expected")))
    rows = named.select("query_id", "rank", "doc_alias", "section_alias", "section_id", "section_title", "section_type",
                        "kind", "doc_limit", F.posexplode("_blocks").alias("pos", "block"))
    unique = dedup_evidence(rows)
    number = Window.partitionBy("query_id", "section_id").orderBy("pos")
    return unique.withColumn("tag", F.concat("doc_alias", F.lit(":"), "section_alias", F.lit(".E"), F.row_number().over(
        number)))


# --- grounding ------------------------------------------------------------------------
def needs_grounding(answer: Column, chars: int | None = None) -> Column:
    """A digit in the answer (its first ``chars`` characters)."""
    return head(answer, chars).rlike(r"\d")


def numbers(c: Column) -> Column:
    """Numbers of a text, digit grouping removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)),
                                        lambda n: F.regexp_replace(n, r",(\d{2,3})(?!\d)", "$1")))


def ungrounded_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence does not hold."""
    return F.array_except(numbers(answer), numbers(evidence))


def numbers_grounded(answer: Column, evidence: Column) -> Column:
    """The answer makes no numeric claim, or all its numbers occur in the evidence."""
    return ~needs_grounding(answer) | (F.size(ungrounded_numbers(answer, evidence)) == 0)


# --- routing --------------------------------------------------------------------------
def route() -> Column:
    """Outcome of a question from its decision columns, first match wins."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    return (F.when(F.col("conversational").isNotNull(), "conversational")
            .when(flag("needs_profile"), "clarify_profile").when(flag("needs_clarification"), "clarify_question")
            .when(flag("faq_hit"), "faq").when(flag("cache_hit"), "cached")
            .when((F.col("sub_questions") > 1) & ~flag("context_dependent"), "compound")
            .when(flag("answerable"), "retrieve").when(flag("fallback_answerable"), "fallback")
            .otherwise("unanswered"))
