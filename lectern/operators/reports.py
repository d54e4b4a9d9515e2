"""Corpus-quality reports and the parsing of text logs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import parse_faq, strip
from lectern.operators.governance import first_rule

# --- fixed values: corpus categories, in order -----------------------------------
CORPUS_CATEGORIES = (
    ("IT Security & Cyber", ("cyber", "security", "siem", "vulnerability", "encryption", "hardening", "ssl",
                             "iam", "firewall", "cloud security", "server", "soc", "incident", "threat", "dlp",
                             "sdr")),
    ("HR & Employment", ("onboarding", "remote", "wfh", "employment", "recruitment", "leave", "salary",
                         "conduct")),
    ("Compliance & Legal", ("compliance", "anti", "slavery", "trafficking", "ethical", "sourcing",
                            "intellectual", "gdpr", "hipaa", "pci", "iso")),
    ("IT Operations & Assets", ("asset", "license", "sop", "inventory", "procurement", "rto", "rpo", "recovery",
                                "backup", "log monitoring", "garbage", "url whitelist")),
)


def _field(text: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, rf"{name}:\s*(.+)", 1)), F.lit("")),
                      F.lit(default))


def parse_ingestion_logs(logs: DataFrame, text: str = "value") -> DataFrame:
    """``Key: value`` lines of an ingestion log to columns."""
    t = F.col(text)
    return logs.select(
        *[c for c in logs.columns if c != text],
        F.coalesce(F.nullif(_field(t, "Canonical title"), F.lit("")), _field(t, "Title")).alias("title"),
        _field(t, "Document type").alias("document_type"), _field(t, "Version").alias("version"),
        _field(t, "Effective date").alias("effective_date"), _field(t, "Audiences").alias("audiences"),
        _field(t, "Tags").alias("tags"), _field(t, "Keywords").alias("keywords"),
        F.coalesce(F.regexp_extract(t, r"Section count:\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("sections"),
        t.contains("=== Document Summary ===").alias("has_summary"), F.when(
            t.contains("=== Document Summary ==="), strip(F.split(F.split(
                t, "=== Document Summary ===", 3)[1], "=== Section", 2)[0])).otherwise("").alias("summary"),
        _field(t, "Source file name").alias("source_file"))


def parse_faq_files(files: DataFrame, doc: str = "document", text: str = "value") -> DataFrame:
    """One row per question-and-answer pair."""
    return files.select(doc, F.posexplode(parse_faq(F.col(text))).alias("n", "p")).select(
        doc, "n", "p.question", "p.answer")


def faq_counts(pairs: DataFrame, doc: str = "document") -> DataFrame:
    return pairs.groupBy(doc).agg(F.count("*").alias("faqs"))


def parse_retrieval_logs(logs: DataFrame, text: str = "value") -> DataFrame:
    """Question, intent, likely documents, top score, answer and answered flag of a retrieval log."""
    t = F.col(text)
    answer = strip(F.regexp_extract(t, r"=== Final Answer ===\s*([\s\S]+?)(?:=== Sources ===|\z)", 1))
    out = logs.select(
        *[c for c in logs.columns if c != text], _field(t, "User question").alias("question"),
        _field(t, "Inferred answer intent").alias("intent"),
        _field(t, "Likely matching documents").alias("top_docs"),
        F.regexp_extract(t, r"score=([\d.]+)", 1).try_cast("double").alias("top_score"), answer.alias("_a"))
    return out.filter(F.col("question") != "").withColumn(
        "answered", (F.col("_a") != "") & ~F.lower("_a").contains("couldn't find")).withColumnRenamed(
        "_a", "answer")


def parse_failures(logs: DataFrame, name: str = "file_name", text: str = "value") -> DataFrame:
    """J4."""
    t = F.col(text)
    return logs.select(F.coalesce(F.nullif(_field(t, "Source file name"), F.lit("")), F.col(name)).alias("file"),
                       _field(t, "Reason", "unknown").alias("reason"))


def corpus_quality(docs: DataFrame) -> DataFrame:
    """Totals and gaps in one aggregate."""
    missing = lambda c, *v: F.count_if(F.coalesce(c, F.lit("")).isin("", *v))
    return docs.agg(
        F.count("*").alias("documents"), F.sum("sections").alias("sections"),
        missing("audiences", "none").alias("missing_audience"),
        missing("effective_date", "unknown").alias("missing_date"),
        missing("version", "unknown").alias("missing_version"),
        F.count_if(F.col("sections") <= 1).alias("single_section"))


def with_category(docs: DataFrame, rules: Sequence = CORPUS_CATEGORIES, title: str = "title",
                  tags: str = "tags") -> DataFrame:
    return docs.withColumn("category", first_rule(F.lower(F.concat_ws(" ", title, tags)), rules, "General"))


def corpus_categories(docs: DataFrame, rules: Sequence = CORPUS_CATEGORIES) -> DataFrame:
    """Documents and share per category."""
    counts = with_category(docs, rules).groupBy("category").agg(F.count("*").alias("documents"))
    total = counts.agg(F.sum("documents").alias("_t"))
    return counts.join(F.broadcast(total)).select("category", "documents", (
        F.col("documents") / F.col("_t")).alias("share"))


def type_distribution(docs: DataFrame) -> DataFrame:
    """J7."""
    return docs.groupBy(F.coalesce(F.nullif(F.col("document_type"), F.lit("")), F.lit("unknown")).alias("document_type")).agg(
        F.count("*").alias("documents"))


def duplicate_titles(docs: DataFrame) -> DataFrame:
    """J8."""
    return docs.groupBy("title").agg(F.count("*").alias("documents")).filter(F.col("documents") > 1)


def top_documents(docs: DataFrame, measure: str, n: int, key: str = "doc_id") -> DataFrame:
    """The ``n`` largest by a measure (10 by questions, 5 by sections)."""
    return docs.orderBy(F.desc(measure), key).limit(n)


def answered_rate(log: DataFrame) -> DataFrame:
    """J10."""
    return log.agg(F.count("*").alias("questions"), F.count_if("answered").alias("answered"),
                   F.avg(F.col("answered").cast("int")).alias("answered_rate"))


def improvement_summary(report: DataFrame) -> DataFrame:
    """Counts per action kind, category and document type, as (dimension, label, n)."""
    action = F.when(F.col("action").contains("Improved"), "improved").when(
        F.col("action").contains("Split"), "split").when(F.col("action").contains("Superseded"), "superseded")
    tall = report.select(F.explode(F.array(
        F.struct(F.lit("action").alias("dimension"), action.alias("label")),
        F.struct(F.lit("category").alias("dimension"), F.nullif(F.col("category"), F.lit("")).alias("label")),
        F.struct(F.lit("doc_type").alias("dimension"), F.nullif(F.col("doc_type"), F.lit("")).alias("label")))).alias("x"))
    return tall.select("x.*").filter(F.col("label").isNotNull()).groupBy("dimension", "label").agg(
        F.count("*").alias("n"))
