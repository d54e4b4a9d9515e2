"""A corpus pipeline over `documents`: quality, near duplicates, benchmark leaks, secrets, tokens."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import codec, decontaminate, near_dups, quality, secrets
from lectern.llm.common import Scratch
from lectern.llm.queries import table

MASK = "[SECRET]"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts.  Rows that share an id stay together if any is accepted; null ids stay."""
    scratch = Scratch(spark)
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), scratch=scratch)
    rejected = Scratch(spark).store(
        scored.groupBy("doc_id").agg(F.max("predicted").alias("best")).filter("best = 0").select("doc_id"))
    scratch.clear()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; rows equal in id and text stay once, null ids stay."""
    scratch = Scratch(spark)
    judged = near_dups.near_documents(docs, size=5, scratch=scratch)
    by_id = Scratch(spark).store(judged.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")))
    scratch.clear()
    # The ids to drop grow with the corpus: a merge join at every size, not one that turns into another.
    left = docs.join(by_id.filter("not kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(docs.columns)
    often = by_id.filter("kept and n > 1").select("doc_id")
    if often.isEmpty():
        return left
    return left.join(often, "doc_id", "left_anti").select(docs.columns).union(
        left.join(often, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null ids stay."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by MASK, n_chars counted anew."""
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*rest).alias("row"), "text")
    found = secrets.scan_secrets(row, id="row", mask=MASK)
    out = found.select(*(F.col(f"doc_id.{c}").alias(c) for c in rest), F.col("masked").alias("text"))
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("sentencepiece", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = scratch.store(made) if k < len(STAGES) - 1 else made
    return docs
