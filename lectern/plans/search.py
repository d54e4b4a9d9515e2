"""Search over sections: index tables, keyword, similarity, vector and hybrid retrieval.

Relevance is BM25 (k1 1.2, b 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5))); of several fields the
best one counts.  All questions of a table are answered by one plan.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions.hof import STRINGS, let, lits, term_frequencies
from lectern.functions.stemming import stem_words
from lectern.functions.text import fold_case, normalize_text, rstrip, truncate, uniq
from lectern.functions.vectors import l2_normalize
from lectern.operators.access import EVERYTHING, Visibility, visibility
from lectern.plans.common import (BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, drop_bucketed, is_small, store,
                                  store_bucketed, term_join, top_k)
from lectern.plans.spelling import near_words

K1, B = 1.2, 0.75
# --- fixed values: stop words of the standard English analyzer (public) ----------
ENGLISH_STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
                "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
                "this", "to", "was", "will", "with")
TEXT_FIELDS = ("section_title", "document_title", "summary", "body")
SIMILARITY_FIELDS = ("body", "summary", "section_title")
ALL = (1 << 31) - 1
SCORES = 4_000_000
BLOCK_SECTIONS = 50_000
ROUND_ROWS, ROUND_BYTES = BROADCAST_ROWS, BROADCAST_BYTES
COMMON_WORDS, COMMON_LENGTH = 200_000, 64


# --- analysis -------------------------------------------------------------------
def analyze(c: Column, stopwords: Sequence[str] = ENGLISH_STOP) -> Column:
    """words of letters and digits, lower case, stop words left out."""
    return F.filter(_words(c), lambda t: ~t.isin(*stopwords))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(fold_case(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def vocabulary(texts: DataFrame, text: str = "text", stopwords: Sequence[str] = ENGLISH_STOP) -> DataFrame:
    """the distinct analyzed words (``term``) of all texts, those of an index of them, without its postings.

    One pass over the texts; a task sends each of its words once, and no text travels.
    """
    return texts.select(F.explode(_words(F.col(text))).alias("term")).distinct().filter(~F.col("term").isin(*stopwords))


# --- index ------------------------------------------------------------------------
@dataclass
class Index:
    """postings(field, term, section_id, doc_id, impact, block), bounds(field, term, block, n, top), terms(field, term,
    df, idf), fields(...).

    Postings come from a table bucketed by section: ``block`` is the bucket, ``top`` a term's largest impact in a block.
    ``stemmed``: terms are stems, and questions are stemmed alike.
    """
    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    fields: DataFrame
    has: Sequence[str] = field(default_factory=tuple)
    blocks: int = 1
    stemmed: bool = False


def build_index(sections: DataFrame, fields: Sequence[str] = TEXT_FIELDS, blocks: int | None = None,
                stem: bool = False) -> Index:
    """index tables of the text fields present, and of ``keywords`` as whole strings.

    A section travels once, with its texts as given, to its bucket; there its terms are counted inside the row and stored
    as one row with the counts of all its fields.  Postings are that table read with its counts as rows, so they are neither shuffled, sorted nor written, and
    summing them per section needs no shuffle either.  A bucket holds some ``BLOCK_SECTIONS`` sections (``blocks``
    gives their number), so what a task holds does not grow with the corpus.  Lengths and document frequencies are
    partial aggregates.  With ``stem`` (F1) every distinct word is stemmed once, the counts of words with one stem are added up inside the bucket and the counts
    of words are deleted; lengths stay those of the words.
    """
    present = [f for f in fields if f in sections.columns]
    n = blocks or max(int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                      -(-sections.count() // BLOCK_SECTIONS))
    counts = [F.struct(F.lit(f).alias("field"), let(analyze(F.col(f)), lambda t: F.struct(
        F.size(t).alias("len"), term_frequencies(t).alias("tfs"))).alias("x")) for f in present]
    if "keywords" in sections.columns:
        whole = uniq(F.transform("keywords", lambda k: normalize_text(k)))
        counts.append(F.struct(F.lit("keywords").alias("field"), F.struct(F.size("keywords").alias("len"), F.transform(
            whole, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"))).alias("tfs")).alias("x")))
    given = [c for c in (*present, "keywords") if c in sections.columns]
    dealt = sections.select("section_id", "doc_id", *given).repartition(n, "section_id")
    rows = dealt.select("section_id", "doc_id", F.pmod(F.hash("section_id"), F.lit(n)).alias("block"), F.filter(
        F.array(*counts), lambda f: f["x"]["len"] > 0).alias("counts"))
    table = store_bucketed(rows, "section_id", n, dealt=True)
    text = F.col("field") != "keywords"
    stats = store(_per_field(table).groupBy("field").agg(F.count("*").alias("n_docs"), F.when(
        ~text, 1.0).otherwise(F.avg("len")).alias("avg_len")))
    if stem:
        words, table = table, store_bucketed(_stemmed(table), "section_id", n, dealt=True)
        drop_bucketed(words)
    tf, share = F.col("tf").cast("double"), F.col("len") / F.col("avg_len")
    postings = _counted(table).join(F.broadcast(stats), "field").select(
        "field", "term", "section_id", "doc_id", F.when(text, tf / (tf + K1 * (1 - B + B * share))).otherwise(
            1 / (1 + K1)).alias("impact"), "block")
    bounds = store(postings.groupBy("field", "term", "block").agg(F.count("*").alias("n"), F.max("impact").alias("top")))
    terms = bounds.groupBy("field", "term").agg(F.sum("n").alias("df")).join(
        F.broadcast(stats), "field").withColumn("idf", F.log(
            1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("field", "term", "df", "idf", "n_docs")
    return Index(postings, bounds, store(terms), stats,
                 (*present, *(["keywords"] if "keywords" in sections.columns else [])), n, stem)


def _per_field(table: DataFrame, *more: str) -> DataFrame:
    return table.select("section_id", "doc_id", "block", *more, F.explode("counts").alias("f")).select(
        "section_id", "doc_id", "block", *more, "f.field", "f.x.len", "f.x.tfs")


def _counted(table: DataFrame, *more: str) -> DataFrame:
    own = ["section_id", "doc_id", "block", *more, "field", "len"]
    return _per_field(table, *more).select(*own, F.explode("tfs").alias("t")).select(
        *own, F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))


def _stemmed(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table of counts with stems for words, a row for each section and field; whole keywords stay as they are.

    The stems that differ from their words are broadcast while their checked size allows it (``most`` rows), and nothing
    is shuffled.  Beyond that the stems of the COMMON_WORDS words most sections hold are broadcast; only the rows of rarer
    words meet the other stems, and what they find comes back to its section as one small map.
    """
    counted = _counted(table)
    text = F.col("field") != "keywords"
    words = store(counted.filter(text).groupBy("term").count())
    stems = store(stem_words(words).select(F.col("word").alias("term"), "stem"))
    near = stems.filter("stem <> term")
    none = F.lit(None).cast("map<string,string>")
    given = table.withColumn("_rare", none)
    if not is_small(near, most):
        often = store(words.filter(F.length("term") <= COMMON_LENGTH).orderBy(F.desc("count"), "term").limit(
            COMMON_WORDS).select("term"))
        others = counted.filter(text).join(F.broadcast(often), "term", "left_anti").select("section_id", "term")
        rare = others.join(near.hint("merge"), "term").groupBy("section_id").agg(
            F.map_from_entries(F.collect_set(F.struct("term", "stem"))).alias("_rare"))
        near = near.join(F.broadcast(often), "term", "left_semi")
        given = table.join(rare.hint("shuffle_hash"), "section_id", "left")
    known = _counted(given, "_rare").join(F.broadcast(near), "term", "left")
    stem = F.when(text, F.coalesce("stem", F.try_element_at("_rare", F.col("term")), "term")).otherwise(F.col("term"))
    own = ["section_id", "doc_id", "block", "field", "len"]
    summed = known.select(*own, "tf", stem.alias("term")).groupBy(*own, "term").agg(F.sum("tf").cast("int").alias("tf"))
    return summed.groupBy(*own).agg(F.collect_list(F.struct("term", "tf")).alias("tfs")).select(
        "section_id", "doc_id", "block", F.array(F.struct("field", F.struct("len", "tfs").alias("x"))).alias("counts"))


def query_terms(questions: DataFrame, text: str = "question", stem: bool = False) -> DataFrame:
    """Distinct analyzed terms of each question with their count."""
    terms = questions.select("query_id", F.explode(term_frequencies(analyze(F.col(text)))).alias("t")).select(
        "query_id", F.col("t.term").alias("term"), F.col("t.tf").alias("qtf"))
    if not stem:
        return terms
    stems = store(stem_words(terms).withColumnRenamed("word", "term"))
    return terms.join(broadcast_if_small(stems), "term").groupBy(
        "query_id", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, match, distance) of every question term against the vocabulary.

    Only words are compared, never texts.  Weight is 1 - distance / length of the shorter word.
    """
    return near_words(terms, vocabulary).withColumn(
        "weight", 1 - F.col("distance") / F.least(F.length("term"), F.length("match")))


# --- channels ---------------------------------------------------------------------
def _pairs(index: Index, wanted: DataFrame, within: DataFrame | None = None, see: Visibility | None = None,
           only: Column | None = None, **join) -> DataFrame:
    """(query_id, section_id, doc_id, field, score) before any cut; F15: only postings of the sections in ``within``.

    F16: under access rules the postings of the asked terms carry the classes that may see their document, and a
    question meets a posting only if its user's class is among them: a hidden section is never scored.
    """
    postings = index.postings if only is None else index.postings.filter(only)
    if within is not None:
        postings = postings.join(within.select("section_id"), "section_id", "left_semi")
    if see is None:
        return term_join(postings, wanted, ["field", "term"], "section_id", **join).withColumn(
            "_s", F.col("w") * F.col("impact"))
    terms = wanted.select("field", "term").distinct()
    marked = see.mark(postings.join(F.broadcast(terms) if join.get("small") else broadcast_if_small(terms),
                                    ["field", "term"], "left_semi"))
    hits = term_join(marked, see.of(wanted), ["field", "term"], "section_id", **join).filter(see.allows())
    return hits.drop("_may", "_class", "_all").withColumn("_s", F.col("w") * F.col("impact"))


def _access(questions: DataFrame, grants: DataFrame | Visibility | None) -> Visibility | None:
    return grants if grants is None or isinstance(grants, Visibility) else visibility(questions, grants)


def _scored(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Scores of (question, section): the best field counts."""
    per_field = [F.sum(F.when(F.col("field") == f, F.col("_s")).otherwise(0.0)) for f in fields]
    best = F.greatest(*per_field) if len(per_field) > 1 else per_field[0]
    return pairs.groupBy("query_id", "section_id", "doc_id").agg(best.alias("score"))


def in_rounds(wanted: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers of a question table too large to broadcast: dealt by question to rounds of some ROUND_ROWS rows and
    ROUND_BYTES of terms (counted), each of them broadcast, one after the other.

    ``answer`` gives a few rows for each question from a round's rows; these are stored.  A round reads the postings where
    they stand, so neither they nor pairs are shuffled, a hot term is spread as its sections are, and only one round is
    in memory at a time.
    """
    n, size = wanted.agg(F.count("*"), F.sum(F.octet_length("term") + F.lit(32))).first()
    rounds = max(2, -(-n // ROUND_ROWS), -(-(size or 0) // ROUND_BYTES))
    place = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
    found = [store(answer(wanted.filter(place == i))) for i in range(rounds)]
    return reduce(DataFrame.unionByName, found)


SLACK = 1e-6                                       # sums in another order differ by less


def threshold_top(index: Index, wanted: DataFrame, k: int, fields: Sequence[str], within: DataFrame | None = None,
                  see: Visibility | None = None, first_blocks: int = 8, report: dict | None = None, **join) -> DataFrame:
    """the first ``k`` sections per question in two passes; ``wanted``: query_id, field, term, w.

    Postings stand in blocks of sections, so a block sums its own sections and no pair is shuffled to be summed.  The
    first pass takes one block in ``first_blocks``: a question's k-th score there is a threshold that its answer
    reaches.  The second pass leaves out, question by question, the blocks whose upper bound (the sum over its terms
    of weight times the block's largest impact) stays below the threshold, and sends on only pairs that reach it, at
    most ``k`` from a block.  Blocks are dealt by hash, so about k * first_blocks pairs of a question pass, whatever the corpus.  A question
    with fewer than k hits in the first pass has no threshold and sends at most k pairs a block.  Nothing is lost.
    A question table that is not small is answered in rounds.
    """
    small = is_small(wanted)                        # then so is all that is a row per question
    near = F.broadcast if small else (lambda df: df)
    join = {"small": small} | join
    if not join["small"]:
        within = None if within is None else store(within.select("section_id"))
        return in_rounds(wanted, lambda part: threshold_top(index, part, k, fields, within, see, first_blocks, small=True))
    part = max(1, index.blocks // first_blocks)
    floor = None
    if part < index.blocks:
        some = _scored(_pairs(index, wanted, within, see, F.col("block") < part, **join), fields)
        floor = store(top_k(some, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(
            F.col("n") == k).select("query_id", (F.col("floor") - SLACK).alias("floor")))
        per_field = index.bounds.join(near(wanted), ["field", "term"]).groupBy("query_id", "block", "field").agg(
            F.sum(F.col("w") * F.col("top")).alias("u"))
        closed = store(per_field.groupBy("query_id", "block").agg(F.max("u").alias("u")).join(near(floor), "query_id").filter(
            F.col("u") < F.col("floor")).groupBy("query_id").agg(F.collect_list("block").alias("_closed")))
        if not closed.isEmpty():
            wanted = wanted.join(near(closed), "query_id", "left")
    pairs = _pairs(index, wanted, within, see, **join)
    if "_closed" in pairs.columns:
        pairs = pairs.filter(~F.coalesce(F.array_contains("_closed", F.col("block")), F.lit(False)))
    scored = _scored(pairs, fields)
    if floor is not None:
        scored = scored.join(near(floor), "query_id", "left").filter(
            F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")
    if report is not None:
        report |= {"matching": _scored(_pairs(index, wanted, within, see, **join), fields).count(), "sent": scored.count()}
    return top_k(scored.withColumn("score", F.round("score", 9)), k)


def keyword_terms(questions: DataFrame, index: Index, boosts: Mapping[str, float] = fixed.FIELD_BOOSTS,
                  fuzzy: bool = False) -> DataFrame:
    """The questions' terms as stored rows (query_id, field, term, w): words in the analyzed fields, whole
    questions in ``keywords``; F5: with ``fuzzy`` the near words of the index as well, each at the weight of its distance."""
    fields = [f for f in index.has if f in boosts]
    terms = query_terms(questions, stem=index.stemmed)
    near = F.broadcast if is_small(questions.select("query_id", "question")) else (lambda df: df)
    analyzed = [f for f in fields if f != "keywords"]
    asked = terms.select("query_id", "term", F.lit(1.0).alias("qw"))
    if fuzzy:
        match = store(fuzzy_terms(terms, index.terms.filter(F.col("field") != "keywords")))
        asked = store(asked.join(broadcast_if_small(match), "term").groupBy("query_id", F.col("match").alias("term")).agg(
            F.max("weight").alias("qw")))
        near = broadcast_if_small
    asked = asked.select("query_id", "term", "qw", F.explode(lits(analyzed)).alias("field"))
    if "keywords" in fields:
        asked = asked.unionByName(questions.select("query_id", normalize_text(F.col("question")).alias("term"),
                                                   F.lit(1.0).alias("qw"), F.lit("keywords").alias("field")))
    boost = F.create_map(*[F.lit(x) for f in fields for x in (f, float(boosts[f]))])
    return store(index.terms.join(near(asked), ["field", "term"]).select(
        "query_id", "field", "term", (F.col("idf") * F.col("qw") * F.element_at(boost, F.col("field"))).alias("w")))


def keyword_scores(questions: DataFrame, index: Index, boosts: Mapping[str, float] = fixed.FIELD_BOOSTS,
                   grants: DataFrame | Visibility | None = None, fuzzy: bool = False, within: DataFrame | None = None,
                   **join) -> DataFrame:
    """the scores of all matching (and visible) sections of each question."""
    wanted = keyword_terms(questions, index, boosts, fuzzy)
    pairs = _pairs(index, wanted, within, _access(questions, grants), **join)
    return _scored(pairs, [f for f in index.has if f in boosts]).withColumn("score", F.round("score", 9))


def keyword_search(questions: DataFrame, index: Index, k: int = 10, boosts: Mapping[str, float] = fixed.FIELD_BOOSTS,
                   grants: DataFrame | Visibility | None = None, fuzzy: bool = False, within: DataFrame | None = None,
                   **join) -> DataFrame:
    """OR of the question's terms, boosted per field, the best field counts; first ``k``."""
    wanted = keyword_terms(questions, index, boosts, fuzzy)
    return threshold_top(index, wanted, k, [f for f in index.has if f in boosts], within, _access(questions, grants), **join)


def similarity_search(questions: DataFrame, index: Index, k: int = 10, max_terms: int = 25, share: float = 0.3,
                      grants: DataFrame | Visibility | None = None, fields: Sequence[str] = SIMILARITY_FIELDS,
                      **join) -> DataFrame:
    """the question's ``max_terms`` best terms by tf·idf; ``share`` of them must match.

    A term is looked up in the field where most sections hold it; its weight is its tf·idf relative
    to the best term's.  Term idf is ln((N + 1) / (df + 1)) + 1.
    """
    terms = query_terms(questions, stem=index.stemmed)
    rated = index.terms.filter(F.col("field").isin(*fields)).join(broadcast_if_small(terms), "term").groupBy(
        "query_id", "term", "qtf").agg(F.max(F.struct("df", "field", "idf", "n_docs")).alias("b"))
    rated = rated.select("query_id", "term", "b.field", "b.idf", F.round(F.col("qtf") * (
        F.log((F.col("b.n_docs") + 1) / (F.col("b.df") + 1)) + 1), 9).alias("tfidf"))
    chosen = top_k(rated, max_terms, score="tfidf", tie="term", rank="_r")
    best = chosen.groupBy("query_id").agg(F.max("tfidf").alias("_best"), F.count("*").alias("_n"))
    wanted = store(chosen.join(best, "query_id").select(
        "query_id", "field", "term", (F.col("idf") * F.col("tfidf") / F.col("_best")).alias("w"),
        F.floor(F.col("_n") * F.lit(share)).alias("need")))
    see = _access(questions, grants)

    def answer(part: DataFrame) -> DataFrame:
        scored = _pairs(index, part, None, see, small=True).groupBy("query_id", "section_id", "doc_id").agg(
            F.sum("_s").alias("score"), F.count("*").alias("_m"), F.first("need").alias("need")).filter(
            F.col("_m") >= F.col("need")).drop("_m", "need")
        return top_k(scored.withColumn("score", F.round("score", 9)), k)
    return answer(wanted) if join.get("small", is_small(wanted)) else in_rounds(wanted, answer)


def _hits(qs: DataFrame, ss: DataFrame) -> str:
    """Schema of hits: ids keep the types they came with."""
    kind = {f.name: f.dataType.simpleString() for f in [*ss.schema, *qs.schema]}
    return ", ".join(f"{c} {kind[c]}" for c in ("query_id", "section_id", "doc_id")) + ", score double" + (
        ", group string" if "group" in ss.columns else "")


def _best_of(matrix: np.ndarray, ids: pd.DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The first ``k`` rows per query of one block, ties by section id; at most SCORES scores are held at once."""
    step, parts = max(1, SCORES // len(matrix)), []
    for lo in range(0, len(queries), step):
        scores = np.round(matrix @ queries[lo:lo + step].T, 9)
        cut = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else scores.min(axis=0)
        row, col = np.nonzero(scores >= cut)
        out = ids.iloc[row].reset_index(drop=True)
        out["query_id"], out["score"] = query_ids[lo:lo + step][col], scores[row, col]
        parts.append(_first(out, k))
    return pd.concat(parts)


def _best_seen(rows: pd.DataFrame, queries: np.ndarray, query_ids: np.ndarray, classes: np.ndarray | None, k: int
               ) -> pd.DataFrame:
    """F16: as `_best_of`, class by class: a class's questions meet the rows its users may see and no others."""
    if "group" not in rows or classes is not None:
        matrix, ids = _stack(rows["v"]), rows[["section_id", "doc_id"]]
    if classes is None:
        return _best_groups(rows, queries, query_ids, k) if "group" in rows else _best_of(matrix, ids, queries, query_ids, k)
    parts = [pd.DataFrame({"section_id": [], "doc_id": [], "query_id": [], "score": []}).astype(
        {"section_id": ids["section_id"].dtype, "doc_id": ids["doc_id"].dtype, "query_id": query_ids.dtype})]
    may = [frozenset(c) if c is not None else frozenset() for c in rows["_may"]]
    for name in dict.fromkeys(classes.tolist()):
        at = np.flatnonzero(classes == name)
        seen = np.arange(len(rows)) if name == EVERYTHING else np.array([i for i, c in enumerate(may) if name in c], int)
        if len(seen):
            parts.append(_best_groups(rows.iloc[seen], queries[at], query_ids[at], k) if "group" in rows else _best_of(
                matrix[seen], ids.iloc[seen], queries[at], query_ids[at], k))
    return pd.concat(parts[1:] or parts)


def _best_groups(rows: pd.DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """As `_best_of`, each group of rows standing for its best row: the first ``k`` groups per query."""
    rows = rows.sort_values(["group", "section_id"], ignore_index=True)
    start = np.flatnonzero(rows["group"].ne(rows["group"].shift()).to_numpy())
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows))))
    matrix, ids = _stack(rows["v"]), rows[["section_id", "doc_id", "group"]]
    step, parts = max(1, SCORES // len(matrix)), []
    for lo in range(0, len(queries), step):
        scores = np.round(matrix @ queries[lo:lo + step].T, 9)
        best = np.maximum.reduceat(scores, start)
        cut = np.partition(best, len(best) - k, axis=0)[len(best) - k] if len(best) > k else best.min(axis=0)
        row, col = np.nonzero((scores == best[of]) & (best[of] >= cut))
        out = ids.iloc[row].reset_index(drop=True)
        out["query_id"], out["score"] = query_ids[lo:lo + step][col], scores[row, col]
        parts.append(_first(out, k))
    return pd.concat(parts)


def _first(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    pairs = pairs.sort_values(["query_id", "score", "section_id"], ascending=[True, False, True])
    if "group" in pairs:
        pairs = pairs.drop_duplicates(["query_id", "group"])
    return pairs.groupby("query_id", sort=False).head(k)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def vector_search(questions: DataFrame, sections: DataFrame, k: int = 10, grants: DataFrame | Visibility | None = None,
                  max_query_values: int = 8_000_000, block_rows: int = 20_000, block_queries: int = 2_000
                  ) -> DataFrame:
    """exact nearest sections by cosine; a question without a vector has no hits.

    Vectors become unit vectors first.  While the questions' vectors fit ``max_query_values``
    (checked), they are broadcast and sections are read once, unshuffled, each task keeping ``k``
    per question.  Beyond that both sides are cut into blocks of bounded size and only ``k`` rows per question leave a
    block; nothing ever emits all pairs.  With a column ``group``, rows of a group stand for one hit, the best of them:
    the first ``k`` groups.  F16: a section carries the classes that may see it and is stored once
    whatever the number of users; only visible pairs are scored.
    """
    unit = lambda df, *c: df.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(
        *c, l2_normalize(F.col("vector")).alias("v"))
    see = _access(questions, grants)
    ss = unit(sections, "section_id", "doc_id", *(["group"] if "group" in sections.columns else []))
    qs = unit(questions, "query_id")
    if see is not None:
        ss, qs = see.mark(ss), see.of(qs).withColumn("_class", F.when(F.col("_all"), EVERYTHING).otherwise(
            F.col("_class"))).drop("_all")
    size = qs.agg(F.sum(F.size("v"))).first()[0] or 0
    found = (_broadcast_vectors(qs, ss, k) if size <= max_query_values
             else _blocked_vectors(qs, ss, k, block_rows, block_queries))
    if "group" in found.columns:
        found = found.groupBy("query_id", "group").agg(F.min_by(F.struct("section_id", "doc_id", "score"), F.struct(
            -F.col("score"), F.col("section_id"))).alias("b")).select("query_id", "group", "b.*")
    return top_k(found, k)


def _broadcast_vectors(qs: DataFrame, ss: DataFrame, k: int) -> DataFrame:
    rows = qs.toPandas()          # size checked by the caller
    schema, columns = _hits(qs, ss), ["query_id", "section_id", "doc_id", "score", *(["group"] if "group" in ss.columns else [])]
    if rows.empty:
        return qs.sparkSession.createDataFrame([], schema)
    classes = rows["_class"].to_numpy() if "_class" in rows else None
    shared = qs.sparkSession.sparkContext.broadcast((_stack(rows["v"]), rows["query_id"].to_numpy(), classes))

    def scan(batches):
        best = None
        for pdf in batches:
            if len(pdf):
                new = _best_seen(pdf, *shared.value, k)
                best = new if best is None else _first(pd.concat([best, new]), k)
        if best is not None:
            yield best[columns]
    return ss.mapInPandas(scan, schema)


def _blocked_vectors(qs: DataFrame, ss: DataFrame, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """Block-by-block product: every block of questions is sent to every block of sections."""
    ss, qs = store(ss), store(qs)
    blocks = [max(1, -(-df.count() // n)) for df, n in ((ss, block_rows), (qs, block_queries))]

    def dealt(df: DataFrame, key: str, own: int) -> DataFrame:
        names = ("sb", "qb")
        return df.withColumn(names[own], F.pmod(F.xxhash64(key), F.lit(blocks[own]))).withColumn(
            names[1 - own], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[1 - own] - 1).cast("long"))))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        return _best_seen(a, _stack(b["v"]), b["query_id"].to_numpy(), b["_class"].to_numpy() if "_class" in b else None, k)[
            columns]
    schema, columns = _hits(qs, ss), ["query_id", "section_id", "doc_id", "score", *(["group"] if "group" in ss.columns else [])]
    return dealt(ss, "section_id", 0).groupBy("sb", "qb").cogroup(dealt(qs, "query_id", 1).groupBy("sb", "qb")).applyInPandas(
        multiply, schema)


# --- blending ----------------------------------------------------------------------
def minmax(hits: DataFrame, by: Sequence[str] = ("query_id",), score: str = "score") -> DataFrame:
    """scores to 0..1 per question; a zero span gives 0 for all."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("norm", F.when(low == high, 0.0).otherwise((F.col(score) - low) / (high - low)))


CHANNELS = ("keyword", "similarity", "vector")


def active_channels(weights: Sequence[float], requested: Sequence[str] = CHANNELS) -> dict[str, float]:
    """requested channels with a weight over zero."""
    return {c: w for c, w in zip(CHANNELS, weights) if c in requested and w > 0}


def blend(channel_hits: Mapping[str, DataFrame], weights: Mapping[str, float], k: int) -> DataFrame:
    """weighted sum of normalized channel scores, a missing channel counts 0.

    Weights are used as given.  Output keeps per-channel scores and the channels that matched.
    """
    tall = None
    for name in weights:
        if name in channel_hits:
            part = channel_hits[name].select("query_id", "section_id", "doc_id", "score", F.lit(name).alias("channel"))
            tall = part if tall is None else tall.unionByName(part)
    norm = minmax(tall, ("query_id", "channel"))
    at = lambda c: F.sum(F.when(F.col("channel") == c, F.col("norm")).otherwise(0.0))
    weight = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))])
    wide = norm.groupBy("query_id", "section_id", "doc_id").agg(
        F.round(F.sum(F.element_at(weight, F.col("channel")) * F.col("norm")), 9).alias("score"),
        *[at(c).alias(c + "_score") for c in CHANNELS], F.sort_array(F.collect_set("channel")).alias("matched_by"))
    return top_k(wide, k)


def hybrid_search(questions: DataFrame, index: Index, vectors: DataFrame | None, k: int = 12,
                  domain: str = "default", requested: Sequence[str] = CHANNELS, rerank: int = 12,
                  grants: DataFrame | Visibility | None = None, **options) -> DataFrame:
    """Channels over-fetch max(2k, rerank), are blended and cut to the first ``k``."""
    wide = max(2 * k, rerank)
    weights = active_channels(fixed.CHANNEL_WEIGHTS[domain], requested)
    hits, grants = {}, _access(questions, grants)
    if "keyword" in weights:
        hits["keyword"] = keyword_search(questions, index, wide, grants=grants, **options)
    if "similarity" in weights:
        hits["similarity"] = similarity_search(questions, index, wide, grants=grants)
    if "vector" in weights and vectors is not None:
        hits["vector"] = vector_search(questions, vectors, wide, grants)
    return blend(hits, weights, wide).filter(F.col("rank") <= k)


def with_domain_weights(questions: DataFrame, domain: str = "domain",
                        table: Mapping[str, Sequence[float]] = fixed.CHANNEL_WEIGHTS) -> DataFrame:
    """channel weights of a question's domain; the default row for any other."""
    rows = F.create_map(*[x for d, w in table.items() for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in w]))])
    chosen = F.coalesce(F.try_element_at(rows, F.col(domain)), F.element_at(rows, "default"))
    return questions.withColumn("_w", chosen).select("*", *[
        F.element_at("_w", n + 1).alias(c + "_weight") for n, c in enumerate(CHANNELS)]).drop("_w")


def prefilter(sections: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    """metadata filter, pushed to the scan; pass the result as ``within`` to a search."""
    for column, values in filters.items():
        sections = sections.filter(F.col(column).isin(*values))
    return sections


def resolve(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """hits with their section row; a missing section gets a minimal one."""
    s = sections.drop("doc_id")
    blank = {"section_title": F.lit(""), "body": F.lit(""), "section_type": F.lit("general")}
    out = hits.join(s, "section_id", "left")
    for name, value in blank.items():
        if name in s.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


# --- document search and questions-and-answers ---------------------------------------
def best_documents(scores: DataFrame) -> DataFrame:
    """The best section of each document among scored sections, ties by section id: a partial aggregate."""
    pick = F.struct(-F.col("score"), F.col("section_id"))
    return scores.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("section_id", "score"), pick).alias("b")).select(
        "query_id", "doc_id", "b.section_id", "b.score")


def search_documents(questions: DataFrame, index: Index, sections: DataFrame, page: int = 1, size: int = 10,
                     grants: DataFrame | Visibility | None = None, **options) -> DataFrame:
    """best section per document of all hits, one page of them; ``total`` counts all documents."""
    best = store(best_documents(keyword_scores(questions, index, grants=grants, **options)))
    ranked = top_k(best, page * size, tie=("section_id",), rank="position")
    total = best.groupBy("query_id").agg(F.count("*").alias("total"))
    shown = ranked.filter(F.col("position") > (page - 1) * size)
    source = F.col("body") if "summary" not in sections.columns else F.coalesce(
        F.nullif(F.col("summary"), F.lit("")), F.col("body"))
    t = F.col("_t")
    snippet = F.concat(rstrip(F.substring(t, 1, 240)), F.when(F.length(t) > 240, "…").otherwise(""))
    return shown.join(sections.select("section_id", "section_title", "document_title", "order_index", source.alias(
        "_t")), "section_id").select(
        "query_id", "position", "doc_id", "section_id", "document_title", "section_title",
        F.bround("score", 4).alias("score"), snippet.alias("snippet")).join(total, "query_id")


def faq_search(questions: DataFrame, faqs: DataFrame, k: int = 30, grants: DataFrame | None = None) -> DataFrame:
    """nearest stored questions over all documents."""
    rows = faqs.select(F.col("faq_id").alias("section_id"), "doc_id", F.col("question_embedding").alias("vector"))
    return vector_search(questions, rows, k, grants).withColumnRenamed("section_id", "faq_id")


def faq_fastpath(questions: DataFrame, faqs: DataFrame, min_score: float = 0.92, grants: DataFrame | None = None,
                 lucene_score: bool = False) -> DataFrame:
    """the best stored question when its cosine (or (1 + cosine) / 2) reaches ``min_score``."""
    best = faq_search(questions, faqs, 1, grants).drop("rank")
    score = (1 + F.col("score")) / 2 if lucene_score else F.col("score")
    return best.withColumn("score", score).filter(F.col("score") >= min_score).join(
        faqs.select("faq_id", F.col("question").alias("faq_question"), "answer"), "faq_id")


def related_questions(questions: DataFrame, faqs: DataFrame, k: int = 3, min_score: float = 0.55,
                      grants: DataFrame | Visibility | None = None) -> DataFrame:
    """up to ``k`` near stored questions, not the asked one, unique whatever the case.

    Stored questions of one folded text are a group of the search, so any number of copies takes one place.
    """
    key = lambda c: fold_case(F.btrim(F.col(c)))
    rows = faqs.select(F.col("faq_id").alias("section_id"), "doc_id", F.col("question_embedding").alias("vector"),
                       key("question").alias("group"))
    hits = vector_search(questions, rows, k + 1, grants).filter(F.col("score") >= min_score)
    own = questions.select("query_id", key("question").alias("group"))
    other = hits.join(broadcast_if_small(own), ["query_id", "group"], "left_anti").drop("rank")
    return top_k(other, k, rank="position").join(faqs.select(F.col("faq_id").alias("section_id"), F.col("question").alias(
        "related")), "section_id").select("query_id", "position", "related", "score")


def faq_evidence(hits: DataFrame, faqs: DataFrame, k: int = 30) -> DataFrame:
    """question-and-answer evidence per question and document, in rank order (at most ``k`` rows a question)."""
    line = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    rows = hits.filter(F.col("rank") <= k).join(faqs.select("faq_id", "document_title", "question", "answer"), "faq_id")
    return rows.groupBy("query_id", "document_title").agg(F.min("rank").alias("first_rank"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda s: s["t"]), "\n").alias("evidence"))


def faq_fallback(title: Column, faq: Column, summary: Column, limit: int = 260) -> Column:
    """F22 without stored vectors: the document's question text, else its summary."""
    body = F.when(F.trim(F.coalesce(faq, F.lit(""))) != "", F.trim(faq)).otherwise(truncate(summary, limit))
    return F.concat(F.lit("["), title, F.lit(" FAQ]\n"), body)


def section_signals(sections: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Words a section answers to: title terms, keywords, tags and title words, its document's too."""
    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9]+"), F.lit(0))
    own = F.concat("title_terms", "keywords", "metadata_tags", words("section_title"))
    if docs is None:
        return sections.select("section_id", "doc_id", F.array_distinct(own).alias("signals"))
    d = docs.select("doc_id", F.concat("title_terms", "keywords", "metadata_tags", words("document_title")).alias("_d"))
    return sections.select("section_id", "doc_id", own.alias("_o")).join(d, "doc_id", "left").select(
        "section_id", "doc_id", F.array_distinct(F.concat("_o", F.coalesce("_d", F.array().cast(STRINGS)))).alias("signals"))


def title_fallback(analysis: DataFrame, signals: DataFrame, k: int = 12, min_score: float = 0.0, **join) -> DataFrame:
    """share of the question's terms among a section's signals; first ``k`` with a hit."""
    terms = analysis.select("query_id", uniq(F.concat("focus_terms", "expanded_terms")).alias("_t")).filter(
        F.size("_t") > 0)
    wanted = store(terms.select("query_id", F.explode("_t").alias("term"), F.size("_t").alias("_n")))
    rows = signals.select("section_id", "doc_id", F.explode("signals").alias("term"))
    scored = term_join(rows, wanted, ["term"], "section_id", **join).groupBy("query_id", "section_id", "doc_id").agg(
        (F.count("*") / F.first("_n")).alias("score"))
    return top_k(scored.filter(F.col("score") >= min_score), k)


def section_hints(fallback: DataFrame, sections: DataFrame, k: int = 5, min_score: float = 0.1) -> DataFrame:
    """labels of the first five sections; a document is named only on its first label."""
    near = fallback.filter((F.col("rank") <= k) & (F.col("score") >= min_score)).join(
        sections.select("section_id", "section_title", "document_title"), "section_id")
    first = near.groupBy("query_id", "document_title").agg(F.min("rank").alias("_f"))
    return near.join(first, ["query_id", "document_title"]).select("query_id", "rank", F.concat(
        F.lit("**"), F.col("section_title"), F.lit("**"), F.when(
            (F.col("rank") == F.col("_f")) & (F.col("document_title") != ""), F.concat(
                F.lit(" (in "), F.col("document_title"), F.lit(")"))).otherwise(F.lit(""))).alias("hint"))


def inject_document(hits: DataFrame, lookups: DataFrame, sections: DataFrame, min_score: float = 0.55) -> DataFrame:
    """lookups(query_id, doc_id, lookup_score) over the mark replace a question's hits by the whole document.

    Both parts read the named documents, which are therefore stored; hits that lookups come from are best stored too.
    """
    named = store(lookups.filter(F.col("lookup_score") >= min_score).groupBy("query_id").agg(F.min_by(
        "doc_id", F.struct(-F.col("lookup_score"), F.col("doc_id"))).alias("doc_id")))
    whole = sections.select("doc_id", "section_id", "order_index").join(broadcast_if_small(named), "doc_id").select(
        "query_id", "section_id", "doc_id", F.lit(1.0).alias("score"), (F.col("order_index") + 1).alias("rank"))
    kept = hits.select("query_id", "section_id", "doc_id", "score", "rank").join(named, "query_id", "left_anti")
    return kept.unionByName(whole)


def merge_subquestions(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits of sub-questions merged per parent: first seen by section, then first by path key.

    ``parents(query_id, parent_id, sub)``; ``hits`` carry ``path_key``.
    """
    order = F.struct("sub", "rank")
    rows = hits.join(parents, "query_id")
    sections = rows.groupBy("parent_id", "section_id").agg(F.min_by(F.struct(
        "sub", "rank", "doc_id", "score", "path_key"), order).alias("b")).select("parent_id", "section_id", "b.*")
    return sections.groupBy("parent_id", "path_key").agg(F.min_by(F.struct(
        "section_id", "doc_id", "score", "sub", "rank"), order).alias("b")).select("parent_id", "path_key", "b.*")
