"""Inputs that queries derive from the given tables, in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.sections import line_sections
from lectern.suite import sql, table

# Words that occur in the test texts, as a lexicon.
LEXICON = {
    "linking": ("and the", "with the", "of thth"),
    "motion": ("into", "from there", "thother", "auf dem"),
    "being": ("was thth", "is thor", "will be ist"),
    "romance": ("de la", "para", "avec les"),
    "german": ("nicht", "der sch", "und die"),
    "nonsense": ("zzzz", "qqqq xxxx"),
}

# (text before, inserted value, text after): t = the whole text, n = the conversation number
TEMPLATES = (
    ("", "t", ""), ("What is the process for ", "t", ""), ("list all contests and what is ", "t", ""),
    ("Can I apply for leave ", "n", ""), ("compare travel policies ", "t", ""),
    ("show me the travel policy ", "n", ""), ("what about this one", "", ""),
    ("am i eligible for ₹1", "n", ",49,000 reimbursement or 2.5 lakh"), ("is this still open", "", ""),
    ("thanks ", "n", ""), ("hello", "", ""),
    ("who approves the expense claim for ", "n", "k and when is the deadline?"), ("why did you miss ", "t", ""),
    ("tell me more ", "n", ""), ("what documents are required? what is the notice period? ", "t", ""),
    ("explain in detail step by step ", "t", ""), ("give me details in a table ", "n", ""),
    ("my approval matrix ", "n", ""), ("open the onboarding diagram", "", ""),
)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions, worded so that every analysis rule is met."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    text = F.lit("")
    for i, (a, kind, b) in enumerate(TEMPLATES):
        value = {"t": F.col("text"), "n": F.col("conv_id").cast("string"), "": F.lit("")}[kind]
        text = F.when((F.col("conv_id") + F.col("turn")) % len(TEMPLATES) == i,
                      F.concat(F.lit(a), value, F.lit(b))).otherwise(text)
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "text",
                        text.alias("question"))


_CASES = " ".join(
    f"WHEN (conv_id + turn) % {len(TEMPLATES)} = {i} THEN {sql.q(a)} || "
    f"{({'t': 'text', 'n': 'conv_id::VARCHAR', '': sql.q('')})[kind]} || {sql.q(b)}"
    for i, (a, kind, b) in enumerate(TEMPLATES))
QUESTIONS = (f"questions AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text, CASE {_CASES} END AS question "
             "FROM conversations WHERE role = 'user')")


def benchmark_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Passages as questions, dealt to the users of the events."""
    n = table(spark, sf, "events").agg(F.max("user_id") + 1).first()[0]
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"),
        (F.col("item_id") % n).cast("string").alias("user_id"))


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """Grants from events: a user gets the document whose id is event_id modulo the number of documents; users divisible by 50 are administrators."""
    ev, n = table(spark, sf, "events"), table(spark, sf, "documents").count()
    some = ev.select(F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % n).cast(
        "string").alias("doc_id"), F.col("ts").cast("timestamp").alias("granted_at"))
    boss = ev.filter("user_id % 50 = 0").select(F.col("user_id").cast("string").alias("user_id"),
                                                F.lit("*").alias("doc_id"), F.col("ts").cast("timestamp").alias("granted_at"))
    return some.unionByName(boss).groupBy("user_id", "doc_id").agg(F.max("granted_at").alias("granted_at"))


GRANTS = ("grants AS (SELECT user_id, doc_id, max(granted_at) AS granted_at FROM (SELECT user_id::VARCHAR AS user_id, "
          "(event_id % (SELECT count(*) FROM documents))::VARCHAR AS doc_id, ts AS granted_at FROM events UNION ALL SELECT user_id::VARCHAR, '*', ts "
          "FROM events WHERE user_id % 50 = 0) GROUP BY 1, 2)")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into one section per line."""
    return line_sections(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))


LINES = ("raw_lines AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace("
         "regexp_replace(replace(text, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), "
         "lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), "
         "lines AS (SELECT doc_id, lang, source, coalesce(l[1], '') AS document_title, i - 1 AS order_index, l[i] AS body, "
         "doc_id || '#' || (i - 1) AS section_id, 'Line ' || i AS section_title "
         "FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM raw_lines))")


def first_line_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents titled by their first line, with a file-like path."""
    d = table(spark, sf, "documents")
    first = F.element_at(F.split("text", "\n"), 1)
    return d.select("doc_id", "lang", "source", "text", first.alias("title"), F.concat(
        F.col("source"), F.lit("/"), F.col("lang"), F.lit("_doc_"), F.col("doc_id"), F.lit(".txt")).alias("source_path"))


TITLED = ("titled AS (SELECT doc_id, lang, source, text, string_split(text, chr(10))[1] AS title, "
          "source || '/' || lang || '_doc_' || doc_id || '.txt' AS source_path, lang || ' doc ' || doc_id AS stem "
          "FROM documents)")
