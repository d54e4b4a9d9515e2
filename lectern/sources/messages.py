"""Ingest messages: JSON lines with plain or base64 content."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import decode_text

SCHEMA = ("content string, encoding string, content_type string, file_name string, source_path string, "
          "domain string, user_ids array<string>, metadata map<string,string>, original_source_path string, sent_at timestamp")


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """Valid and bad rows in one table: ``error`` is null for a usable message.

    A message needs content and a source path; base64 content must decode.
    """
    m = raw.withColumn("m", F.from_json(value, SCHEMA))
    plain = F.when(F.col("m.encoding") == "base64", decode_text(F.try_to_binary("m.content", F.lit("base64")))
                   ).otherwise(F.col("m.content"))
    error = (F.when(F.col("m").isNull() | (F.col("m.content").isNull() & F.col("m.source_path").isNull()), "not a message")
             .when(F.col("m.source_path").isNull(), "no source path")
             .when(plain.isNull(), "no content"))
    return m.select(*[c for c in raw.columns], plain.alias("text"), "m.content_type", "m.file_name",
                    "m.source_path", "m.domain", F.coalesce("m.user_ids", F.array().cast("array<string>")).alias(
                        "user_ids"), "m.metadata", "m.sent_at", error.alias("error"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error", "value")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("value", "error")


def read_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over a folder of JSON-lines files."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_messages(reader.load(path))
