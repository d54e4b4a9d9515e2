"""Reranking of retrieved sections: feature columns, the blended score and diverse selection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions.hof import STRINGS, let
from lectern.functions.text import (is_digits, keywordize, normalize_text, profile_is_empty, profile_tags,
                                    tokenize, uniq)
from lectern.operators.evidence import evidence_blocks, snippets, topic_alignment


# --- features ------------------------------------------------------------------
def term_overlap(query: Column, candidate: Column) -> Column:
    """Share of the question's distinct terms that the candidate holds."""
    return let(uniq(query), lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, candidate)) / F.size(q)))


def _phrase_score(terms: Column, text: Column, weigh, cap: float) -> Column:
    return let(normalize_text(text), lambda n: F.least(F.lit(cap), F.aggregate(
        uniq(terms), F.lit(0.0), lambda acc, t: let(F.translate(t, "_", " "), lambda p: acc + F.when(
            (p != "") & n.contains(p), weigh(t)).otherwise(F.lit(0.0))))))


def focus_match(terms: Column, text: Column) -> Column:
    """1.0 per word pair, 0.45 per word found in the text, at most 2."""
    return _phrase_score(terms, text, lambda t: F.when(t.contains("_"), 1.0).otherwise(0.45), 2.0)


def precise_match(terms: Column, text: Column) -> Column:
    """1.0 per word pair or number, 0.5 per word of three characters or more, at most 3."""
    return _phrase_score(terms, text, lambda t: F.when(
        t.contains("_") | F.exists(F.split(t, "_"), is_digits), 1.0).when(F.length(t) >= 3, 0.5).otherwise(0.0), 3.0)


def precise_count(terms: Column, title: Column, text: Column) -> Column:
    """G4 rounded half up."""
    return F.floor(precise_match(terms, F.concat_ws(" ", title, text)) + 0.5).cast("int")


def role_alignment(profile: Column, *signals: Column) -> Column:
    """Share of the profile's tags among section tags, keywords and audiences."""
    found = F.transform(F.concat(*[F.coalesce(s, F.array().cast(STRINGS)) for s in signals]), F.lower)
    return F.when(profile_is_empty(profile), F.lit(0.0)).otherwise(let(profile_tags(profile), lambda t: F.size(
        F.array_intersect(t, found)) / F.greatest(F.size(t), F.lit(1))))


def boost_preferred(hits: DataFrame, active: DataFrame, boost: float = 0.08) -> DataFrame:
    """G1: active(query_id, section_id) of the previous answer of a follow-up gain ``boost``."""
    keyed = active.select("query_id", "section_id").distinct().withColumn("_p", F.lit(boost))
    return hits.join(keyed, ["query_id", "section_id"], "left").withColumn(
        "score", F.col("score") + F.coalesce("_p", F.lit(0.0))).drop("_p")


# --- scores ----------------------------------------------------------------------
FEATURES = ("base", "snippet", "type", "tag", "role", "title", "focus", "precise")


def rerank(candidates: DataFrame, preset: str = "high", profile: str | None = None) -> DataFrame:
    """Feature columns and ``h_score``, one projection per candidate row.

    A candidate row carries the question's analysis, its section and ``score``.
    """
    c = F.col
    two = snippets(evidence_blocks(preset=preset, limit=2), 2, fixed.PRESETS[preset]["snippet_chars"])
    out = candidates.withColumn("_snip", F.array_join(two, " "))
    terms = F.when(F.size("expanded_terms") > 0, c("expanded_terms")).otherwise(c("focus_terms"))
    doc_terms = F.coalesce("doc_title_terms", F.array().cast(STRINGS)) if "doc_title_terms" in candidates.columns \
        else F.array().cast(STRINGS)
    signals = [c(x) for x in ("metadata_tags", "keywords", "audiences") if x in candidates.columns]
    summary = c("summary") if "summary" in candidates.columns else F.lit("")
    out = (out.withColumn("base", c("score"))
           .withColumn("snippet", term_overlap(terms, keywordize(c("_snip"))))
           .withColumn("type", F.array_contains("expected_section_types", c("section_type")).cast("double"))
           .withColumn("tag", topic_alignment(c("topic_hints"), c("metadata_tags")))
           .withColumn("role", role_alignment(c(profile), *signals) if profile else F.lit(0.0))
           .withColumn("title", term_overlap(F.concat("focus_terms", "topic_hints"), F.concat("title_terms", doc_terms)))
           .withColumn("focus", focus_match(c("focus_terms"), F.concat_ws(" ", "section_title", summary, "_snip", "body")))
           .withColumn("precise", precise_match(c("focus_terms"), F.concat_ws(" ", "section_title", "_snip", "body"))))
    total = sum((F.lit(w) * c(n) for n, w in fixed.RERANK_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("h_score", total).drop("_snip")


def score_details(reranked: DataFrame) -> DataFrame:
    """Every feature rounded to four places, half to even."""
    for n in (*FEATURES, "h_score"):
        reranked = reranked.withColumn(n, F.bround(n, 4))
    return reranked


def blend_relevance(reranked: DataFrame, supplied: DataFrame, limit: int = 12, skip_at: float = 0.82) -> DataFrame:
    """0.70 heuristic + 0.30 supplied relevance (clamped to 0..1) over the first ``limit`` candidates.

    A missing score counts as the heuristic; questions whose best heuristic reaches ``skip_at``
    keep it.  ``supplied(query_id, section_id, relevance)``.
    """
    best = reranked.groupBy("query_id").agg(F.max("h_score").alias("_best"))
    given = supplied.select("query_id", "section_id", F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), F.col("relevance"))).alias("_rel"))
    out = reranked.join(best, "query_id").join(given, ["query_id", "section_id"], "left")
    usable = F.when(F.col("rank") <= limit, F.col("_rel"))
    skipped = F.col("_best") >= skip_at
    return out.withColumn("relevance_skipped", skipped).withColumn("final_score", F.when(
        skipped, F.col("h_score")).otherwise(F.lit(0.70) * F.col("h_score") + F.lit(0.30) * F.coalesce(
            usable, F.col("h_score")))).drop("_best", "_rel")


# --- limits and selection -----------------------------------------------------------
def limits(analysis: DataFrame, preset: str = "high") -> DataFrame:
    """Candidate and result limits by question class."""
    p = fixed.PRESETS[preset]
    broad = F.col("multi_doc_expected")
    lookup = F.array_contains("intents", "document_lookup")
    exact = F.col("exact_match_expected")
    wide = max(p["broad_rerank"], p["rerank"])
    tight = max(p["exact_rerank"], p["exact_sections_per_doc"] * 2, p["exact_max_sections"] * 2)
    many = max(p["broad_max_sections"], p["max_sections"])
    few = max(1, min(p["exact_max_sections"], p["max_sections"]))
    pick = lambda b, e, o: F.when(broad, b).when(exact, e).when(lookup, b).otherwise(o)
    return analysis.withColumn("rerank_limit", pick(wide, tight, p["rerank"])).withColumn(
        "result_limit", pick(many, few, p["max_sections"]))


def diversify(scored: DataFrame, score: str = "final_score") -> DataFrame:
    """The best section of each document first, then the rest; plain order for exact questions.

    Rows carry exact_match_expected and result_limit; ``position`` is the new place.
    """
    per_doc = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(score), "section_id")
    out = scored.withColumn("_first", (F.row_number().over(per_doc) == 1) | F.col("exact_match_expected"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_first"), F.desc(score), "section_id")
    return out.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= F.col("result_limit")).drop("_first")


def docs_from_sections(hits: DataFrame, preferred: DataFrame | None = None, score: str = "score",
                       boost: float = 0.08) -> DataFrame:
    """Documents by their best section, +``boost`` when active before, ranked."""
    docs = hits.groupBy("query_id", "doc_id").agg(F.max(score).alias("doc_score"))
    if preferred is not None:
        keyed = preferred.select("query_id", "doc_id").distinct().withColumn("_p", F.lit(boost))
        docs = docs.join(keyed, ["query_id", "doc_id"], "left").withColumn(
            "doc_score", F.col("doc_score") + F.coalesce("_p", F.lit(0.0))).drop("_p")
    w = Window.partitionBy("query_id").orderBy(F.desc("doc_score"), "doc_id")
    return docs.withColumn("doc_rank", F.row_number().over(w))


def merge_rankings(docs: DataFrame, hits: DataFrame, score: str = "score") -> DataFrame:
    """Two document rankings merged by the higher score."""
    both = docs.select("query_id", "doc_id", "doc_score").unionByName(hits.select(
        "query_id", "doc_id", F.col(score).alias("doc_score")))
    return docs_from_sections(both, None, "doc_score")


def sources(hits: DataFrame, path_key: str = "path_key", score: str = "score", floor: float = 0.24,
            scale: float = 0.45) -> DataFrame:
    """Best section per document path; under max(floor, scale·best) dropped, the first always kept."""
    best = hits.groupBy("query_id", path_key).agg(F.min_by(F.struct("section_id", "doc_id", F.col(score).alias("score"),
                                                                    "rank"), "rank").alias("b")).select(
        "query_id", path_key, "b.*")
    top = best.groupBy("query_id").agg(F.min("rank").alias("_r"), F.max_by("score", -F.col("rank")).alias("_s"))
    return best.join(top, "query_id").filter((F.col("rank") == F.col("_r")) | (F.col("score") >= F.greatest(
        F.lit(floor), F.lit(scale) * F.col("_s")))).drop("_r", "_s")


def lookup_score(candidates: DataFrame, title: str = "canonical_title") -> DataFrame:
    """0.5 title phrase + 0.35 title coverage + 0.15 term overlap, at most 1, for lookups only."""
    toks = lambda c: F.array_distinct(tokenize(c))
    title_toks = F.filter(toks(F.col(title)), lambda t: ~t.isin(*fixed.LOOKUP_TITLE_IGNORED_TOKENS))
    n = normalize_text(F.col(title))
    phrase = ((n != "") & normalize_text(F.col("question")).contains(n)).cast("double")
    terms = F.when(F.size("expanded_terms") > 0, F.col("expanded_terms")).otherwise(F.col("focus_terms"))

    def build(t):
        cover = F.size(F.array_intersect(toks(F.col("question")), t)) / F.size(t)
        return F.when(F.size(t) == 0, phrase).otherwise(F.least(F.lit(1.0), F.lit(0.5) * phrase + F.lit(
            0.35) * cover + F.lit(0.15) * term_overlap(terms, F.concat("title_terms", "keywords"))))
    return candidates.withColumn("lookup_score", F.when(F.array_contains("intents", "document_lookup"), let(
        title_toks, build)).otherwise(F.lit(0.0)))
