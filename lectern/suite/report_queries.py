"""Reports and evaluation."""
from pyspark.sql import functions as F

from lectern.operators import evaluation as V, governance as G, reports as R
from lectern.plans import search as S
from lectern.plans.common import substring_join
from lectern.suite import inputs, query, sql, table
from lectern.suite import metadata_queries as MQ, search_queries as SQ, text_queries as TQ

_NL = "chr(10)"
_LOGS = (f"logs AS (SELECT doc_id, lang, source, text, 'Source file name: ' || source || '_' || doc_id || '.html' || {_NL} || 'Title: T ' || doc_id || {_NL} || 'Canonical title: ' || lang || ' title ' || (doc_id % 300) || {_NL} "
         f"|| 'Document type: ' || CASE WHEN doc_id % 7 = 0 THEN 'policy' ELSE 'form' END || {_NL} || 'Version: ' || CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE '1.' || (doc_id % 4) END || {_NL} || 'Audiences: none' || {_NL} "
         f"|| 'Section count: ' || (doc_id % 5) || {_NL} || '=== Document Summary ===' || {_NL} || text || {_NL} || '=== Section 1' AS value FROM documents)")


def _logs(spark, sf):
    d = table(spark, sf, "documents")
    lit = F.lit
    value = F.concat(lit("Source file name: "), "source", lit("_"), "doc_id", lit(".html\nTitle: T "), "doc_id", lit("\nCanonical title: "), "lang", lit(" title "), F.col("doc_id") % 300,
                     lit("\nDocument type: "), F.when(F.col("doc_id") % 7 == 0, "policy").otherwise("form"), lit("\nVersion: "), F.when(
                         F.col("doc_id") % 3 == 0, lit("unknown")).otherwise(F.concat(lit("1."), F.col("doc_id") % 4)), lit("\nAudiences: none\nSection count: "), F.col("doc_id") % 5,
                     lit("\n=== Document Summary ===\n"), "text", lit("\n=== Section 1"))
    return d.select("doc_id", "lang", "source", value.alias("value"))


def _docs(spark, sf):
    return R.parse_ingestion_logs(_logs(spark, sf)).withColumn("tags", F.concat_ws(" ", "lang", "source"))


_DOCS = ("docs AS (SELECT doc_id, lang || ' title ' || (doc_id % 300) AS title, CASE WHEN doc_id % 7 = 0 THEN 'policy' ELSE 'form' END AS document_type, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE '1.' || (doc_id % 4) END AS version, "
         "'none' AS audiences, (doc_id % 5)::INT AS sections, lang || ' ' || source AS tags, text, source || '_' || doc_id || '.html' AS source_file FROM documents)")


@query("report_ingestion_logs", f"""
WITH {_DOCS} SELECT doc_id, title, document_type, version, audiences, sections, source_file, true AS has_summary, md5({sql.strip('text')}) AS summary FROM docs""")
def report_ingestion_logs(spark, sf):
    """J1."""
    return _docs(spark, sf).select("doc_id", "title", "document_type", "version", "audiences", "sections", "source_file", "has_summary", F.md5("summary").alias("summary"))


@query("report_faq_files", f"""
WITH {TQ.PAIRS} SELECT conv_id, count(*) AS faqs, md5(string_agg(question || answer, '|' ORDER BY n)) AS pairs FROM faq_pairs GROUP BY 1""")
def report_faq_files(spark, sf):
    """J2."""
    pairs = R.parse_faq_files(TQ.faq_texts(spark, sf), "conv_id", "faq")
    joined = pairs.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat("question", "answer").alias("t")))),
                                                                        lambda s: s["t"]), "|")).alias("pairs"))
    return R.faq_counts(pairs, "conv_id").join(joined, "conv_id")


_A = f"CASE WHEN conv_id % 4 = 0 THEN 'I couldn''t find it. ' ELSE '' END || text"
_RLOG = "CASE WHEN conv_id % 4 = 0 THEN 'I couldn''t find it. ' ELSE '' END || text"


def _retrieval_logs(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    a = F.concat(F.when(F.col("conv_id") % 4 == 0, "I couldn't find it. ").otherwise(""), "text")
    return c.select("conv_id", "turn", F.concat(
        F.lit("User question: what about "), "conv_id", F.lit("\nInferred answer intent: timeline\nLikely matching documents: doc "), "turn", F.lit("\n- hit score=0."), (F.col("turn") % 9 + 1),
        F.lit(" x\n=== Final Answer ===\n"), a, F.lit("\n=== Sources ===\n- none")).alias("value"))


@query("report_retrieval_logs", f"""
WITH a AS (SELECT conv_id, turn, {sql.strip(_A)} AS a FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 'what about ' || conv_id AS question, 'timeline' AS intent, 'doc ' || turn AS top_docs, ('0.' || (turn % 9 + 1))::DOUBLE AS top_score, a <> '' AND NOT contains(lower(a), 'couldn''t find') AS answered,
  md5(a) AS answer FROM a""")
def report_retrieval_logs(spark, sf):
    """J3."""
    return R.parse_retrieval_logs(_retrieval_logs(spark, sf)).withColumn("answer", F.md5("answer"))


@query("report_answered_rate", f"""
WITH a AS (SELECT {sql.strip(_A)} AS a FROM conversations WHERE role = 'assistant'), b AS (SELECT a <> '' AND NOT contains(lower(a), 'couldn''t find') AS ok FROM a)
SELECT count(*) AS questions, count(*) FILTER (ok) AS answered, round(avg(ok::INT), 6) AS answered_rate FROM b""")
def report_answered_rate(spark, sf):
    """J10."""
    return R.answered_rate(R.parse_retrieval_logs(_retrieval_logs(spark, sf))).withColumn("answered_rate", F.round("answered_rate", 6))


@query("report_failures", """
SELECT CASE WHEN event_id % 3 = 0 THEN 'log_' || event_id ELSE 'doc' || event_id || '.pdf' END AS file, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type || ' ' || props END AS reason
FROM events WHERE event_type = 'error'""")
def report_failures(spark, sf):
    """Error events as failure logs, some without a file name or a reason."""
    e = table(spark, sf, "events").filter("event_type = 'error'")
    value = F.concat(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("Source file name: doc"), "event_id", F.lit(".pdf\n"))),
                     F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("Reason: "), "event_type", F.lit(" "), "props")))
    return R.parse_failures(e.select(F.concat(F.lit("log_"), "event_id").alias("file_name"), value.alias("value")))


@query("report_quality", f"""
WITH {_DOCS} SELECT count(*) AS documents, sum(sections)::BIGINT AS sections, count(*) FILTER (audiences IN ('', 'none')) AS missing_audience, count(*) AS missing_date,
  count(*) FILTER (version = 'unknown') AS missing_version, count(*) FILTER (sections <= 1) AS single_section FROM docs""")
def report_quality(spark, sf):
    """J5."""
    return R.corpus_quality(_docs(spark, sf))


CATEGORIES = (("Nordic", ("de ", "src1")), ("Latin", ("fr", "es ")), ("Plain", ("en title 1",)))


@query("report_categories", f"""
WITH {_DOCS}, c AS (SELECT {MQ.rule_sql("lower(title || ' ' || tags)", CATEGORIES, 'General')} AS category FROM docs), g AS (SELECT category, count(*) AS documents FROM c GROUP BY 1)
SELECT category, documents, round(documents / sum(documents) OVER (), 6) AS share FROM g""")
def report_categories(spark, sf):
    """J6."""
    return R.corpus_categories(_docs(spark, sf), CATEGORIES).withColumn("share", F.round("share", 6))


@query("report_types", f"WITH {_DOCS} SELECT CASE WHEN doc_id % 14 = 0 THEN 'unknown' ELSE document_type END AS document_type, count(*) AS documents FROM docs GROUP BY 1")
def report_types(spark, sf):
    """Some types blanked."""
    d = _docs(spark, sf).withColumn("document_type", F.when(F.col("doc_id") % 14 == 0, "").otherwise(F.col("document_type")))
    return R.type_distribution(d)


@query("report_duplicate_titles", f"WITH {_DOCS} SELECT title, count(*) AS documents FROM docs GROUP BY 1 HAVING count(*) > 1")
def report_duplicate_titles(spark, sf):
    """J8."""
    return R.duplicate_titles(_docs(spark, sf))


@query("report_top_documents", f"""
WITH {inputs.LINES}, n AS (SELECT doc_id, count(*) AS sections FROM lines GROUP BY 1) SELECT doc_id, sections FROM n ORDER BY sections DESC, doc_id LIMIT 5""")
def report_top_documents(spark, sf):
    """The five largest by sections."""
    n = inputs.lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("sections"))
    return R.top_documents(n, "sections", 5)


@query("report_top_by_questions", f"""
WITH {TQ.PAIRS}, n AS (SELECT conv_id AS doc_id, count(*) AS faqs FROM faq_pairs GROUP BY 1) SELECT doc_id, faqs FROM n ORDER BY faqs DESC, doc_id LIMIT 10""")
def report_top_by_questions(spark, sf):
    """Ten documents with most stored questions."""
    return R.top_documents(R.faq_counts(R.parse_faq_files(TQ.faq_texts(spark, sf).withColumnRenamed("conv_id", "doc_id"), "doc_id", "faq"), "doc_id"), "faqs", 10)


@query("report_improvements", f"""
WITH {MQ.REPORT}, a AS (SELECT *, CASE row_number() OVER (ORDER BY source) % 10 WHEN 0 THEN 'x' ELSE action END AS x FROM report)
SELECT 'action' AS dimension, 'improved' AS label, count(*) AS n FROM report UNION ALL SELECT 'category', category, count(*) FROM report GROUP BY 2 UNION ALL SELECT 'doc_type', doc_type, count(*) FROM report GROUP BY 2""")
def report_improvements(spark, sf):
    """J11."""
    return R.improvement_summary(G.improvement_report(MQ._files(spark, sf)))


# --- evaluation -------------------------------------------------------------------------
_CAT = MQ.rule_sql("lower(question)", V.CATEGORY_WORDS, "general")


@query("eval_cases", f"""
WITH {TQ.PAIRS}, new AS (SELECT 'faq_' || conv_id || '_' || n AS id, question, array_to_string(list_filter(list_transform(string_split(answer, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS answer,
  conv_id::VARCHAR AS doc, {_CAT} AS category, 'easy' AS difficulty, false AS verified FROM faq_pairs),
old AS (SELECT * REPLACE ('edited ' || id AS question, 'hard' AS difficulty, true AS verified) FROM new WHERE doc::INT % 3 = 0 UNION ALL SELECT 'manual_' || conv_id, 'm', 'a', conv_id::VARCHAR, 'limit', 'hard', true FROM conversations WHERE turn = 0)
SELECT id, md5(question) AS question, md5(answer) AS expected_answer, doc AS source_document, category, difficulty, verified FROM new WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT id, md5(question), md5(answer), doc, category, difficulty, verified FROM old""")
def eval_cases(spark, sf):
    """Cases of stored questions; a third were edited, manual ones stay."""
    out = _cases(spark, sf)
    return out.select("id", F.md5("question").alias("question"), F.md5("expected_answer").alias("expected_answer"), "source_document", "category", "difficulty", "verified")


def _cases(spark, sf):
    faqs = TQ.faq_texts(spark, sf).withColumn("source_document", F.col("conv_id").cast("string"))
    none = spark.createDataFrame([], "id string, question string, expected_answer string, source_document string, source_section string, category string, difficulty string, verified boolean")
    fresh = V.build_cases(faqs, none)
    edited = fresh.filter(F.col("source_document").cast("int") % 3 == 0).withColumn("question", F.concat(F.lit("edited "), "id")).withColumn(
        "difficulty", F.lit("hard")).withColumn("verified", F.lit(True))
    first = table(spark, sf, "conversations").filter("turn = 0")
    lit = F.lit
    manual = first.select(F.concat(lit("manual_"), "conv_id").alias("id"), lit("m").alias("question"), lit("a").alias("expected_answer"), F.col("conv_id").cast("string").alias(
        "source_document"), lit("").alias("source_section"), lit("limit").alias("category"), lit("hard").alias("difficulty"), lit(True).alias("verified"))
    return V.build_cases(faqs, edited.unionByName(manual))


@query("eval_filtered_cases", f"""
WITH {TQ.PAIRS} SELECT 'faq_' || conv_id || '_' || n AS id FROM faq_pairs WHERE conv_id % 3 = 0 AND {_CAT} = 'general'""")
def eval_filtered_cases(spark, sf):
    """Verified hard general cases."""
    return V.filter_cases(_cases(spark, sf), True, "general", "hard").select("id")


# cases: passages that occur in a document; expected is the first such document
TRUTH = """truth AS (SELECT b.item_id AS query_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"""
_CASES = (f"cases AS (SELECT b.item_id AS id, 'Report of doc ' || coalesce(doc_id::VARCHAR, 'none') || ' end' AS expected, CASE WHEN b.item_id % 5 = 0 THEN 'line' ELSE '' END AS section, "
          "['limit', 'procedure', 'definition'][b.item_id % 3 + 1] AS category, ['easy', 'hard'][b.item_id % 2 + 1] AS difficulty FROM benchmark b LEFT JOIN truth t ON t.query_id = b.item_id)")


_SERIES = ("alpha", "bravo", "delta", "gamma")


def _named(doc):
    """A document's series by id, in SQL."""
    return f"({sql.arr(_SERIES)})[({doc}) % 4 + 1]"


_NAMED = f"""named AS (SELECT c.id, coalesce(t.doc_id, c.id) AS doc FROM cases c LEFT JOIN truth t ON t.query_id = c.id),
wanted AS (SELECT id, CASE id % 4 WHEN 0 THEN '  ' || upper({_named('doc')}) || ' chapter ' || doc || ' ' WHEN 1 THEN 'chapter_' || {_named('doc')} || '-appendix other_' || {_named('doc')}
  WHEN 2 THEN 'unknown paper' ELSE ' ' END AS document, CASE WHEN id % 3 = 0 THEN ' LINE ' || (id % 9 + 1) ELSE NULL END AS section FROM named),
rule AS (SELECT *, list_distinct(list_filter(string_split_regex(e, '[\\s\\-_]+'), lambda t: length(t) >= 4)) AS toks FROM (SELECT id, lower(trim(document)) AS e, lower(trim(coalesce(section, ''))) AS sec FROM wanted)),
top AS (SELECT query_id, rank, lower('Handbook ' || {_named('doc_id')} || ' chapter ' || doc_id) AS title, lower('Line ' || (string_split(section_id, '#')[2]::BIGINT + 1)) AS section FROM khits WHERE rank <= 3),
res AS (SELECT r.id, min(rank) FILTER (e = '' OR ((contains(title, e) OR (len(toks) > 0 AND len(list_filter(toks, lambda t: contains(title, t))) >= greatest(1, len(toks) // 2))) AND (sec = '' OR contains(section, sec)))) AS r
  FROM rule r LEFT JOIN top h ON h.query_id = r.id GROUP BY 1)"""
_EVAL = f"{SQ.KEYWORD}, {TRUTH}, {_CASES}, {_NAMED}"
_BODY_RUN = """kb AS (SELECT query_id, section_id, doc_id, round(s / 1.0, 9) AS score FROM kpf WHERE field = 'body'),
khits2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM kb)"""


def _series(doc):
    return F.element_at(F.array(*[F.lit(x) for x in _SERIES]), (doc % 4 + 1).cast("int"))


@query("eval_results", f"WITH {_EVAL} SELECT id, coalesce(r = 1, false) AS hit_at_1, r IS NOT NULL AS hit_at_3, round(coalesce(1.0 / r, 0), 6) AS reciprocal_rank FROM res")
def eval_results(spark, sf):
    """Cases name the document whole, by its longer words, wrongly or not at all, some with a section."""
    hits = S.keyword_search(SQ.questions(spark, sf), SQ.index(spark, sf), 3, ALL).select(
        F.col("query_id").alias("id"), "rank", F.concat(F.lit("Handbook "), _series(F.col("doc_id")), F.lit(" chapter "), "doc_id").alias("document_title"),
        F.concat(F.lit("Line "), F.element_at(F.split("section_id", "#"), 2).cast("long") + 1).alias("section_title"))
    d, b = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    truth = substring_join(d, "doc_id", "text", b, "passage").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    doc, way, lit = F.coalesce("doc_id", "item_id"), F.col("item_id") % 4, F.lit
    cases = b.join(truth, "item_id", "left").select(
        F.col("item_id").alias("id"),
        F.when(way == 0, F.concat(lit("  "), F.upper(_series(doc)), lit(" chapter "), doc, lit(" ")))
        .when(way == 1, F.concat(lit("chapter_"), _series(doc), lit("-appendix other_"), _series(doc)))
        .when(way == 2, "unknown paper").otherwise(" ").alias("source_document"),
        F.when(F.col("item_id") % 3 == 0, F.concat(lit(" LINE "), F.col("item_id") % 9 + 1)).alias("source_section"))
    return V.score_cases(cases, hits).select("id", "hit_at_1", "hit_at_3", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


# a run whose hits are named by bare numbers: only the true document matches
def _strict(spark, sf, boosts):
    ix = SQ.index(spark, sf)
    hits = S.keyword_search(SQ.questions(spark, sf), ix, 3, boosts).select(F.col("query_id").alias("id"), "rank", F.concat(F.lit("<"), "doc_id", F.lit(">")).alias(
        "document_title"), F.lit("Line").alias("section_title"))
    d, b = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    truth = substring_join(d, "doc_id", "text", b, "passage").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    at = lambda *v: F.array(*[F.lit(x) for x in v])
    cases = b.join(truth, "item_id", "left").select(
        F.col("item_id").alias("id"), F.concat(F.lit("<"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(">")).alias("source_document"),
        F.lit("").alias("source_section"), F.element_at(at("limit", "procedure", "definition"), (F.col("item_id") % 3 + 1).cast("int")).alias("category"),
        F.element_at(at("easy", "hard"), (F.col("item_id") % 2 + 1).cast("int")).alias("difficulty"))
    return V.score_cases(cases, hits).withColumn("latency_ms", (F.col("id") * 7 % 41).cast("double")).withColumn("via_faq", F.col("id") % 4 == 0).withColumn(
        "error", F.when(F.col("id") % 13 == 0, "timeout").otherwise(""))


ALL = {"section_title": 4.0, "document_title": 3.0, "keywords": 3.0, "body": 1.0}


def _strict_sql(name, hits):
    return (f"{name} AS (SELECT c.id, c.category, c.difficulty, (SELECT min(rank) FROM {hits} h WHERE h.query_id = c.id AND rank <= 3 AND h.doc_id = t.doc_id) AS r, (c.id * 7 % 41)::DOUBLE AS latency, c.id % 4 = 0 AS faq, "
            "CASE WHEN c.id % 13 = 0 THEN 'timeout' ELSE '' END AS error FROM cases c LEFT JOIN truth t ON t.query_id = c.id)")


_STRICT = f"{SQ.KEYWORD}, {TRUTH}, {_CASES}, {_strict_sql('res', 'khits')}, ok AS (SELECT * FROM res WHERE error = '')"


@query("eval_summary", f"""
WITH {_STRICT}, s AS (SELECT list_sort(list(latency)) AS l FROM ok)
SELECT count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_at_3, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr,
  round(avg(faq::INT), 6) AS faq_share, (SELECT count(*) FROM res WHERE error <> '') AS errors, (SELECT l[len(l) // 2 + 1] FROM s) AS p50, (SELECT l[floor(len(l) * 0.95::DOUBLE)::INT + 1] FROM s) AS p95 FROM ok""")
def eval_summary(spark, sf):
    """J17."""
    out = V.eval_summary(_strict(spark, sf, ALL))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "mrr", "faq_share")], "errors", "p50", "p95")


@query("eval_breakdown", f"""
WITH {_STRICT}, t AS (SELECT 'category' AS dimension, category AS label, r FROM ok UNION ALL SELECT 'difficulty', difficulty, r FROM ok)
SELECT dimension, label, count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1 ELSE 0 END), 6) AS hit_at_1 FROM t GROUP BY 1, 2""")
def eval_breakdown(spark, sf):
    """J18."""
    return V.eval_breakdown(_strict(spark, sf, ALL)).withColumn("hit_at_1", F.round("hit_at_1", 6))


@query("eval_misses", f"WITH {_STRICT} SELECT id, (SELECT '<' || doc_id || '>' FROM khits h WHERE h.query_id = ok.id AND rank = 1) AS got FROM ok WHERE r IS NULL")
def eval_misses(spark, sf):
    """J19."""
    return V.eval_misses(_strict(spark, sf, ALL)).select("id", "got")


_COMPARE = f"{_STRICT}, {_BODY_RUN}, {_strict_sql('res2', 'khits2')}"


@query("eval_comparison", f"""
WITH {_COMPARE}, j AS (SELECT a.id, coalesce(a.r = 1, false) AS x, coalesce(b.r = 1, false) AS y FROM res a JOIN res2 b USING (id)),
m AS (SELECT (SELECT avg(CASE WHEN r = 1 THEN 1 ELSE 0 END) FROM res WHERE error = '') AS ha, (SELECT avg(CASE WHEN r = 1 THEN 1 ELSE 0 END) FROM res2 WHERE error = '') AS hb,
  (SELECT avg(coalesce(1.0 / r, 0)) FROM res WHERE error = '') AS ma, (SELECT avg(coalesce(1.0 / r, 0)) FROM res2 WHERE error = '') AS mb)
SELECT count(*) AS common, count(*) FILTER (x AND NOT y) AS regressions, count(*) FILTER (y AND NOT x) AS improvements, round(any_value(hb - ha), 6) AS hit_at_1_delta, round(any_value(mb - ma), 6) AS mrr_delta FROM j, m""")
def eval_comparison(spark, sf):
    """All fields against the body alone."""
    out = V.compare_runs(_strict(spark, sf, ALL), _strict(spark, sf, {"body": 1.0}))
    return out.select("common", "regressions", "improvements", F.round("hit_at_1_delta", 6).alias("hit_at_1_delta"), F.round("mrr_delta", 6).alias("mrr_delta"))


@query("eval_changed_cases", f"""
WITH {_COMPARE}, j AS (SELECT a.id, coalesce(a.r = 1, false) AS x, coalesce(b.r = 1, false) AS y FROM res a JOIN res2 b USING (id))
SELECT id, CASE WHEN x THEN 'regression' ELSE 'improvement' END AS change FROM j WHERE x <> y""")
def eval_changed_cases(spark, sf):
    """The cases that moved."""
    return V.changed_cases(_strict(spark, sf, ALL), _strict(spark, sf, {"body": 1.0}))
