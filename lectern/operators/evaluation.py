"""Retrieval evaluation: cases, hits, rates, breakdowns and run comparison."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.hof import any_contains, let
from lectern.functions.text import parse_faq, strip
from lectern.plans.common import store

# --- fixed values: category words, in order -------------------------------------
CATEGORY_WORDS = (
    ("limit", ("maximum", "minimum", "limit", "cap", "how much", "how many", "what is the")),
    ("entitlement", ("eligible", "entitle", "qualify", "can i", "am i", "do i")),
    ("procedure", ("how do i", "how to", "process", "apply", "steps", "procedure")),
    ("exception", ("exception", "exempt", "unless", "maternity", "leave", "if i am")),
    ("definition", ("define", "definition", "what does", "what is meant", "what counts")),
    ("negative", ("not covered", "not mentioned", "no mention", "does not")),
)


def guess_category(question: Column, words: Sequence = CATEGORY_WORDS) -> Column:
    """J13."""
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for name, phrases in words:
        out = F.coalesce(out, F.when(any_contains(low, phrases), F.lit(name)))
    return F.coalesce(out, F.lit("general"))


def case_answers(faq: Column) -> Column:
    """Pairs of a question file; blank lines inside an answer are dropped."""
    return F.transform(parse_faq(faq), lambda p: F.struct(p["question"].alias("question"), F.array_join(
        F.filter(F.transform(F.split(p["answer"], "\n"), strip), lambda x: x != ""), "\n").alias("expected_answer")))


CASE = ("id", "question", "expected_answer", "source_document", "source_section", "category", "difficulty",
        "verified")


def build_cases(faqs: DataFrame, existing: DataFrame, doc: str = "source_document", faq: str = "faq") -> DataFrame:
    """One case per pair, id ``faq_{document}_{n}``; existing rows win and manual rows stay."""
    new = faqs.select(doc, F.posexplode(case_answers(F.col(faq))).alias("n", "p")).select(
        F.concat(F.lit("faq_"), F.col(doc), F.lit("_"), F.col("n")).alias("id"), "p.question", "p.expected_answer",
        F.col(doc).alias("source_document"), F.lit("").alias("source_section"),
        guess_category(F.col("p.question")).alias("category"), F.lit("easy").alias("difficulty"),
        F.lit(False).alias("verified"))
    old = existing.select(F.col("id"), F.struct(*CASE).alias("_old"))
    kept = new.select("id", F.struct(*CASE).alias("_new")).join(old, "id", "left").select(
        F.coalesce("_old", "_new").alias("c")).select("c.*")
    return kept.unionByName(existing.select(*CASE).filter(~F.col("id").startswith("faq_")))


def filter_cases(cases: DataFrame, verified_only: bool = False, category: str | None = None,
                 difficulty: str | None = None) -> DataFrame:
    """J14."""
    out = cases.filter("verified") if verified_only else cases
    out = out.filter(F.col("category") == category) if category else out
    return out.filter(F.col("difficulty") == difficulty) if difficulty else out


def is_hit(expected_doc: Column, expected_section: Column, doc_title: Column, section_title: Column) -> Column:
    """Document by name or by half of its longer words, section by containment."""
    doc, sec = F.lower(strip(F.coalesce(expected_doc, F.lit("")))), F.lower(strip(F.coalesce(
        expected_section, F.lit(""))))
    title = F.lower(doc_title)

    def same_doc(e):
        toks = F.array_distinct(F.filter(F.split(e, r"[\s\-_]+"), lambda t: F.length(t) >= 4))
        return title.contains(e) | let(toks, lambda ts: (F.size(ts) > 0) & (
            F.size(F.filter(ts, lambda t: title.contains(t))) >= F.greatest(F.lit(1), F.floor(F.size(ts) / 2))))
    return (doc == "") | (let(doc, same_doc) & ((sec == "") | F.lower(section_title).contains(sec)))


def score_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """hit@1, hit@3 and reciprocal rank within three.

    ``hits(id, rank, document_title, section_title)``; only the first three ranks are joined.  Cases are read twice and
    so are stored first: whatever they are derived from runs once.
    """
    cases = store(cases)
    top = hits.filter(F.col("rank") <= 3).select("id", "rank", "document_title", F.col("section_title").alias("_s"))
    joined = cases.join(top, "id", "left").withColumn("_hit", is_hit(
        F.col("source_document"), F.col("source_section"), F.col("document_title"), F.col("_s")) & F.col("rank").isNotNull())
    per = joined.groupBy("id").agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_r"),
                                   F.min_by("document_title", "rank").alias("got"))
    return cases.join(per, "id").withColumn("hit_at_1", F.coalesce(F.col("_r") == 1, F.lit(False))).withColumn(
        "hit_at_3", F.col("_r").isNotNull()).withColumn(
        "reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("_r"), F.lit(0.0))).drop("_r")


def _rate(c: str) -> Column:
    return F.avg(F.col(c).cast("int"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Rates over rows without an error; p50 is element n/2 and p95 element int(0.95 n).

    Percentiles come from the histogram of distinct latencies, never from one collected list.
    """
    results = store(results.select("hit_at_1", "hit_at_3", "reciprocal_rank", "via_faq", "latency_ms", "error"))
    ok = results.filter(F.coalesce("error", F.lit("")) == "")
    totals = ok.agg(F.count("*").alias("n"), _rate("hit_at_1").alias("hit_at_1"), _rate("hit_at_3").alias("hit_at_3"),
                    F.avg("reciprocal_rank").alias("mrr"), _rate("via_faq").alias("faq_share"))
    errors = results.agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
    return totals.join(F.broadcast(errors)).join(F.broadcast(exact_elements(ok, "latency_ms", (0.5, 0.95))))


def exact_elements(df: DataFrame, value: str, shares: Sequence[float], buckets: int = 1024) -> DataFrame:
    """Exact order statistics ``sorted[int(n * share)]`` as p50, p95 … of finite values; nulls do not count.

    Each share's element is narrowed down by histograms: values between two bounds are counted in equal ranges, and the
    range that holds the position goes on with its own least and largest value, until these are one.  At most
    ``buckets`` counts come to the driver a round, and ranges are taken from values alone, however rows are partitioned.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).filter("v is not null")
    least, most, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    found = []
    for s in shares:
        low, high, position = least, most, int(n * s)
        while low is not None and low < high:
            place = F.least(F.floor((F.col("v") - low) / (high - low) * buckets), F.lit(buckets - 1))
            for r in rows.filter(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(
                    F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
                if position < r["n"]:
                    low, high = r["low"], r["high"]
                    break
                position -= r["n"]
        found.append(low)
    names = [f"p{round(s * 100)}" for s in shares]
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{c} double" for c in names))


def eval_breakdown(results: DataFrame) -> DataFrame:
    """Counts and hit@1 by category and by difficulty in one pass."""
    ok = results.filter(F.coalesce("error", F.lit("")) == "").withColumn("_h", F.col("hit_at_1").cast("int"))
    sets = ok.groupingSets([[F.col("category")], [F.col("difficulty")]], F.col("category"), F.col("difficulty"))
    return sets.agg(F.count("*").alias("n"), F.avg("_h").alias("hit_at_1")).select(
        F.when(F.col("category").isNotNull(), "category").otherwise("difficulty").alias("dimension"),
        F.coalesce("category", "difficulty").alias("label"), "n", "hit_at_1")


def eval_misses(results: DataFrame) -> DataFrame:
    """J19."""
    return results.filter((F.coalesce("error", F.lit("")) == "") & ~F.col("hit_at_3"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics of both full runs, with regressions and improvements over the common cases."""
    def metrics(df, p):
        ok = F.coalesce("error", F.lit("")) == ""
        return df.agg(F.avg(F.when(ok, F.col("hit_at_1").cast("int"))).alias(p + "_hit_at_1"),
                      F.avg(F.when(ok, F.col("reciprocal_rank"))).alias(p + "_mrr"))
    a, b = (store(df.select("id", "hit_at_1", "reciprocal_rank", "error")) for df in (a, b))
    both = a.select("id", F.col("hit_at_1").alias("_a")).join(b.select("id", F.col("hit_at_1").alias("_b")), "id")
    moves = both.agg(F.count("*").alias("common"), F.count_if(F.col("_a") & ~F.col("_b")).alias("regressions"),
                     F.count_if(~F.col("_a") & F.col("_b")).alias("improvements"))
    out = moves.join(F.broadcast(metrics(a, "a"))).join(F.broadcast(metrics(b, "b")))
    return out.withColumn("hit_at_1_delta", F.col("b_hit_at_1") - F.col("a_hit_at_1")).withColumn(
        "mrr_delta", F.col("b_mrr") - F.col("a_mrr"))


def changed_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cases whose hit@1 changed."""
    both = a.select("id", F.col("hit_at_1").alias("_a")).join(b.select("id", F.col("hit_at_1").alias("_b")), "id")
    return both.filter(F.col("_a") != F.col("_b")).select("id", F.when(
        F.col("_a"), "regression").otherwise("improvement").alias("change"))
