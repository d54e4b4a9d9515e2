"""Folder scans, text decoding and the tables that drive an ingest run."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import fixed
from lectern.functions.hof import any_contains
from lectern.functions.text import decode_text, file_name, strip


def scan_folder(spark: SparkSession, path: str, extensions: Sequence[str] = tuple(fixed.CONTENT_TYPES),
                excluded: Sequence[str] = fixed.GENERATED_NAME_PARTS) -> DataFrame:
    """A1-A3: one row per file of a folder (not of its subfolders) with its content type.

    Names are filtered before contents are read: unneeded ``content`` columns are never loaded.
    """
    files = spark.read.format("binaryFile").load(path)
    return exclude_generated(with_content_type(files, "path"), "path", excluded).filter(
        extension(F.col("path")).isin(*extensions))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def with_content_type(df: DataFrame, path: str = "path") -> DataFrame:
    """A3: content type by extension; an unknown one gives status ``skipped`` with a reason."""
    table = F.create_map(*[F.lit(x) for kv in fixed.CONTENT_TYPES.items() for x in kv])
    kind = F.try_element_at(table, extension(F.col(path)))
    return df.withColumn("content_type", kind).withColumn(
        "status", F.when(kind.isNull(), "skipped")).withColumn(
        "reason", F.when(kind.isNull(), F.concat(F.lit("unsupported type "), extension(F.col(path)))))


def exclude_generated(df: DataFrame, path: str = "path",
                      parts: Sequence[str] = fixed.GENERATED_NAME_PARTS) -> DataFrame:
    """A2: leave out generated artefacts by parts of the lower-cased file name."""
    return df.filter(~any_contains(F.lower(file_name(F.col(path))), parts))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A1-A4: text and HTML files of a folder, decoded."""
    files = scan_folder(spark, path).filter(F.col("content_type").isin("text", "html"))
    return files.select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source_path"), "content_type",
                        "modificationTime", decode_text(F.col("content")).alias("text"))


def skip_indexed(new: DataFrame, documents: DataFrame, path: str = "source_path",
                 content_hash: str | None = None) -> DataFrame:
    """A5: documents whose path (and, if asked, content hash) is not indexed yet."""
    keys = [path] + ([content_hash] if content_hash else [])
    return new.join(documents.select(*keys).distinct(), keys, "left_anti")


def stale_only(sources: DataFrame, derived: DataFrame, key: str = "source_path") -> DataFrame:
    """Sources without a derived artefact at least as new as themselves."""
    newest = derived.groupBy(key).agg(F.max("modificationTime").alias("_d"))
    return sources.join(newest, key, "left").filter(
        F.col("_d").isNull() | (F.col("_d") < F.col("modificationTime"))).drop("_d")


def explode_parts(df: DataFrame, parts: str = "parts", path: str = "source_path") -> DataFrame:
    """One document per part; each keeps the parent's columns and names it as original path."""
    keep = [c for c in df.columns if c not in (parts, path)]
    return df.select(*keep, F.col(path).alias("original_source_path"), F.posexplode(parts).alias("part", "text")
                     ).withColumn(path, F.concat("original_source_path", F.lit("#"), F.col("part")))


# --- outcomes --------------------------------------------------------------------
def ingest_log(docs: DataFrame, path: str = "source_path", text: str = "text",
               content_type: str = "content_type", indexed: str | None = None) -> DataFrame:
    """Outcome and reason per document; a bad row is a row of the log, not a failed run."""
    t = F.col(text)
    reason = (F.when(F.col(content_type).isNull(), "unsupported type")
              .when(t.isNull(), "unreadable").when(strip(t) == "", "no text"))
    if indexed:
        reason = F.coalesce(reason, F.when(F.col(indexed), F.lit("already indexed")))
    return docs.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "ingested").when(F.col("reason") == "unreadable", "failed")
        .otherwise("skipped")).select(path, "status", F.coalesce("reason", F.lit("")).alias("reason"))


def drop_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    """A7."""
    return docs.filter(strip(F.coalesce(F.col(text), F.lit(""))) != "")


def ingest_summary(log: DataFrame) -> DataFrame:
    """Processed, skipped and failed totals."""
    return log.agg(F.count_if(F.col("status").isin("ingested", "processed")).alias("processed"),
                   F.count_if(F.col("status") == "skipped").alias("skipped"),
                   F.count_if(F.col("status") == "failed").alias("failed"))


def ingest_progress(log: DataFrame, manifest: DataFrame, path: str = "source_path") -> DataFrame:
    """A10: processed, total and percent to one place; 0 percent for an empty manifest."""
    done = log.select(path).distinct().withColumn("_d", F.lit(1))
    return manifest.select(path).distinct().join(done, path, "left").agg(
        F.count("_d").alias("processed"), F.count("*").alias("total")).withColumn(
        "percent", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
            F.bround(F.col("processed") / F.col("total") * 100, 1)))


# --- tables ------------------------------------------------------------------------
def upsert(table: DataFrame, batch: DataFrame, key: str | Sequence[str], version: str | None = None) -> DataFrame:
    """The table with the batch written over it by key, no duplicates.

    The later row wins: batch over table and, inside the batch, the highest ``version`` (all
    columns break ties).  One partial aggregate, no window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    both = table.withColumn("_src", F.lit(0)).unionByName(batch.withColumn("_src", F.lit(1)))
    order = F.struct("_src", *([version] if version else []), F.xxhash64(*batch.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*table.columns), order).alias("_r")).select("_r.*")


def faq_rows(docs: DataFrame, pairs: str = "faq_pairs", vectors: str = "faq_vectors",
             doc: str = "doc_id") -> DataFrame:
    """One row per pair and vector; the shorter list decides; id ``{doc}_faq_{n}``."""
    n = F.least(F.size(pairs), F.size(vectors))
    zipped = F.slice(F.arrays_zip(F.col(pairs).alias("p"), F.col(vectors).alias("v")), F.lit(1),
                     F.greatest(n, F.lit(0)))
    keep = [c for c in docs.columns if c not in (pairs, vectors)]
    return docs.select(*keep, F.posexplode(zipped).alias("n", "z")).select(
        *keep, F.concat(F.col(doc).cast("string"), F.lit("_faq_"), F.col("n")).alias("faq_id"),
        F.col("z.p.question").alias("question"), F.col("z.p.answer").alias("answer"),
        F.col("z.v").alias("question_embedding"))


def delete_documents(ids: DataFrame, *tables: DataFrame, doc: str = "doc_id") -> list[DataFrame]:
    """Documents, sections, questions and grants without the deleted documents."""
    gone = ids.select(F.col(doc).cast("string").alias("_gone")).distinct()
    return [t.withColumn("_gone", F.col(doc).cast("string")).join(gone, "_gone", "left_anti").drop("_gone")
            for t in tables]


def document_bundle(docs: DataFrame, sections: DataFrame, doc: str = "doc_id", limit: int | None = None) -> DataFrame:
    """A document with all its sections nested in order, or the first ``limit`` (a page of them)."""
    first = sections if limit is None else sections.filter(F.col("order_index") < limit)
    nested = first.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(
        "order_index", "section_id", "section_title", "body"))).alias("sections"))
    return docs.join(nested, doc, "left")


def sections_of(sections: DataFrame, ids: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All sections of the given documents, score 1.0."""
    return sections.join(ids.select(doc).distinct(), doc, "left_semi").withColumn("score", F.lit(1.0))


def corpus_counts(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """A16."""
    return docs.agg(F.count("*").alias("documents")).join(F.broadcast(sections.agg(
        F.count("*").alias("sections"))))


# quotes doubled and blanks kept, so that any text comes back as it was; a null is an empty field, an empty text ""
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """An export read back.  Texts may hold line ends, so a file is one task: export in pieces of a task's size."""
    empty = uuid.uuid4().hex                              # the reader tells "" from a null by a value of its own alone
    raw = spark.read.schema(schema).options(multiLine=True, emptyValue=empty, **CSV).csv(path)
    return raw.select(*[F.when(F.col(f.name) == empty, "").otherwise(F.col(f.name)).alias(f.name)
                        if f.dataType.typeName() == "string" else f.name for f in raw.schema])


def write_lines(df: DataFrame, path: str, per_file: int = 1000) -> None:
    """Rows as JSON lines in text files of at most ``per_file`` rows, a folder that `scan_folder` reads."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").option(
        "maxRecordsPerFile", per_file).text(path)


def read_lines(files: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """The rows of scanned and decoded files of JSON lines, with their file's other columns."""
    keep = [c for c in files.columns if c != text]
    line = F.explode(F.filter(F.split(F.col(text), "\n"), lambda x: x != "")).alias("_l")
    return files.select(*keep, line).select(*keep, F.from_json("_l", schema).alias("_r")).select(*keep, "_r.*")
