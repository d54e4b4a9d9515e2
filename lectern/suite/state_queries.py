"""Conversation state, usage and streams."""
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import conversation as C, questions as Q, usage as U
from lectern.operators.sections import line_sections
from lectern.plans.common import session_dir, store
from lectern.sources import messages as M
from lectern.streaming import jobs
from lectern.suite import inputs, query, sql, table


def messages(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


_MSG = "messages AS (SELECT conv_id AS thread_id, turn AS seq, role, text AS content FROM conversations)"


def _label(x, n):
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'New chat' ELSE {sql.truncate(x, n)} END"


@query("state_threads", f"""
WITH {_MSG}, g AS (SELECT thread_id, count(*) AS message_count, max(seq) AS last_seq, arg_max(role, seq) AS last_role, arg_max(content, seq) AS last_content,
  arg_min(content, seq) FILTER (role = 'user') AS fu FROM messages GROUP BY 1)
SELECT thread_id, message_count, last_seq, last_role, md5(last_content) AS last_content, {_label('fu', 56)} AS title, {sql.truncate('last_content', 96)} AS preview FROM g""")
def state_threads(spark, sf):
    """I1, I4, I6."""
    m = messages(spark, sf)
    return C.thread_state(m).withColumn("last_content", F.md5("last_content")).join(
        C.thread_summary(m).select("thread_id", "preview"), "thread_id")


@query("state_recent_messages", f"""
WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS n FROM messages) SELECT thread_id, seq, role, md5(content) AS content FROM r WHERE n <= 3""")
def state_recent_messages(spark, sf):
    """The last three messages, uncut."""
    return C.recent_messages(messages(spark, sf), 3, compact=False).withColumn("content", F.md5("content"))


@query("state_previous_pairs", f"""
WITH {_MSG}, q AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w, '') AS lq FROM messages WINDOW w AS (PARTITION BY thread_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN {{'a': content, 'q': lq}} END IGNORE NULLS) OVER w AS p FROM q WINDOW w AS (PARTITION BY thread_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT thread_id, seq, md5(coalesce(p.a, '')) AS previous_answer, md5(coalesce(p.q, '')) AS previous_question FROM a""")
def state_previous_pairs(spark, sf):
    """I3."""
    return C.previous_pair(messages(spark, sf)).select("thread_id", "seq", F.md5("previous_answer").alias("previous_answer"),
                                                       F.md5("previous_question").alias("previous_question"))


@query("state_topics", f"""
WITH {_MSG} SELECT thread_id, seq, CASE WHEN seq % 2 = 0 THEN 'leave, travel' ELSE {_label('content', 90)} END AS topic FROM messages WHERE role = 'user'""")
def state_topics(spark, sf):
    """I4: topic label from hints, else from the question."""
    hints = F.when(F.col("seq") % 2 == 0, F.array(F.lit("leave"), F.lit("travel"))).otherwise(F.array().cast("array<string>"))
    return messages(spark, sf).filter("role = 'user'").select("thread_id", "seq", C.current_topic(hints, F.col("content")).alias("topic"))


@query("state_thread_lists", """
WITH t AS (SELECT user_id, event_id AS thread_id, ts AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position FROM events) SELECT user_id, thread_id, position FROM t WHERE position <= 20""")
def state_thread_lists(spark, sf):
    """Events as threads of their user."""
    t = table(spark, sf, "events").select("user_id", F.col("event_id").alias("thread_id"), F.col("ts").alias("updated_at"))
    return C.list_threads(t).select("user_id", "thread_id", "position")


@query("state_summary_due", f"WITH {_MSG} SELECT thread_id, least(count(*), 10) >= 4 AS summary_due FROM messages GROUP BY 1")
def state_summary_due(spark, sf):
    """I7 with a window of 10 and a trigger of 4."""
    return C.summary_due(messages(spark, sf), 10, 4)


@query("state_after_reset", f"""
WITH {_MSG}, r AS (SELECT thread_id, max(seq) AS r FROM messages WHERE role = 'system' GROUP BY 1) SELECT m.thread_id, m.seq FROM messages m LEFT JOIN r USING (thread_id) WHERE m.seq > coalesce(r, -1)""")
def state_after_reset(spark, sf):
    """I8: a system turn resets its thread."""
    return C.after_reset(messages(spark, sf), F.col("role") == "system").select("thread_id", "seq")


@query("state_resumed_questions")
def state_resumed_questions(spark, sf):
    """Clarifications over templated user turns (a sequential state machine: no SQL)."""
    q = Q.analyze_questions(inputs.questions(spark, sf))
    c = F.col
    turns = q.select(c("conv_id").alias("thread_id"), c("turn").alias("seq"), c("question").alias("content"), Q.needs_profile(
        c("normalized_question"), c("intents"), c("topic_hints")).alias("ask_profile"), Q.needs_clarification(
        c("normalized_question"), c("intents"), c("topic_hints"), c("focus_terms"), c("context_dependent"), F.lit(True)).alias("ask_question"))
    return C.resume_questions(turns)


@query("state_carried_documents", f"""
WITH {_MSG}, a AS (SELECT thread_id, seq, 'd' || seq || '|' || role AS docs FROM messages WHERE role = 'assistant')
SELECT thread_id, seq, coalesce(lag(docs) OVER (PARTITION BY thread_id ORDER BY seq), '') AS active_docs FROM a""")
def state_carried_documents(spark, sf):
    """I10."""
    a = messages(spark, sf).filter("role = 'assistant'").select("thread_id", "seq", F.array(F.concat(F.lit("d"), "seq"), "role").alias("docs"))
    return C.carry_active(a, "docs").select("thread_id", "seq", F.array_join("active_docs", "|").alias("active_docs"))


_SRC = "CASE WHEN page_id % 2 = 0 THEN url ELSE upper(replace(url, '/', chr(92))) END"


@query("state_unique_sources", f"""
WITH s AS (SELECT page_id % 20 AS thread_id, page_id AS rank, {_SRC} AS source_path FROM pages UNION ALL SELECT page_id % 20, page_id + 1000, url FROM pages)
SELECT thread_id, lower(replace(source_path, chr(92), '/')) AS path_key, min(rank) AS rank FROM s GROUP BY 1, 2""")
def state_unique_sources(spark, sf):
    """Every page cited twice, with slashes and case changed."""
    p = table(spark, sf, "pages")
    src = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.upper(F.translate("url", "/", "\\")))
    thread = (F.col("page_id") % 20).alias("thread_id")
    s = p.select(thread, F.col("page_id").alias("rank"), src.alias("source_path")).unionByName(p.select(
        thread, (F.col("page_id") + 1000).alias("rank"), F.col("url").alias("source_path")))
    return C.unique_sources(s).select("thread_id", "path_key", "rank")


def _log(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("query_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit(" Q"), F.col("user_id") % 3).alias(
        "question"), F.array(F.lit("b"), F.lit("a")).alias("active_docs"), (F.col("event_id") % 10 == 0).alias("context_dependent"),
        (F.col("event_id") % 4 != 0).alias("answerable"))


@query("state_answer_cache", """
WITH RECURSIVE l AS (SELECT event_id, ts, event_type || ' q' || (user_id % 3) AS k, event_id % 4 <> 0 AS ok FROM events WHERE event_id % 10 <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM l),
w AS (SELECT k, n, event_id, false AS hit, CASE WHEN ok THEN ts END AS stored FROM o WHERE n = 1
  UNION ALL SELECT o.k, o.n, o.event_id, coalesce(o.ts - w.stored <= INTERVAL 1 HOUR, false), CASE WHEN coalesce(o.ts - w.stored <= INTERVAL 1 HOUR, false) THEN w.stored WHEN o.ok THEN o.ts END
  FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1)
SELECT event_id AS query_id, hit FROM w""")
def state_answer_cache(spark, sf):
    """Events as a question log; fifteen hot questions."""
    return C.answer_cache(_log(spark, sf)).select("query_id", "hit")


@query("state_cache_expiry", """
SELECT event_id FROM events WHERE ts + INTERVAL 1 HOUR >= (SELECT date_trunc('day', max(ts)) FROM events) AND event_type <> 'view'""")
def state_cache_expiry(spark, sf):
    """Entries alive at the start of the last day, one prefix cleared."""
    ev = table(spark, sf, "events")
    now = ev.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    cache = ev.select("event_id", F.concat("event_type", F.lit(":"), "event_id").alias("key"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"))
    return C.expire(cache, now, "view:").select("event_id")


@query("state_source_images", """
WITH s AS (SELECT lower('P/' || source) AS k, doc_id, lang || doc_id AS image FROM documents), d AS (SELECT DISTINCT source FROM documents)
SELECT d.source, s.doc_id AS order_index, s.image FROM d JOIN s ON s.k = 'p/' || d.source""")
def state_source_images(spark, sf):
    """One image per document, found by its source."""
    d = table(spark, sf, "documents")
    s = d.select(F.concat(F.lit("P\\"), "source").alias("source_path"), F.col("doc_id").alias("order_index"), F.array(F.concat("lang", "doc_id")).alias("images"))
    asked = d.select("source", F.concat(F.lit("p/"), "source").alias("source_path")).distinct()
    return C.source_images(asked, s).select("source", "order_index", "image")


# --- usage -------------------------------------------------------------------------------
PRICES = (("view", 2.0, 8.0), ("click", 0.5, 1.5), ("purchase", 5.0, 25.0), ("error", None, 3.0))
_PRICES = "prices AS (SELECT * FROM (VALUES ('view', 2.0::DOUBLE, 8.0::DOUBLE), ('click', 0.5, 1.5), ('purchase', 5.0, 25.0), ('error', NULL, 3.0)) t(model_name, pi, po))"
_USAGE = ("usage AS (SELECT event_id AS request_id, event_type AS model_name, floor(value * 10)::BIGINT - 5 AS input_tokens, json_extract_string(props, '$.k')::BIGINT AS output_tokens, ts FROM events)")
COSTED = (f"{_PRICES}, {_USAGE}, costed AS (SELECT u.request_id, u.model_name, u.ts, greatest(0, input_tokens) AS it, greatest(0, output_tokens) AS ot, greatest(0, input_tokens) / 1000000.0::DOUBLE * pi AS ic, "
          "greatest(0, output_tokens) / 1000000.0::DOUBLE * po AS oc FROM usage u LEFT JOIN prices USING (model_name)), "
          "totals AS (SELECT *, CASE WHEN ic IS NOT NULL OR oc IS NOT NULL THEN coalesce(ic, 0) + coalesce(oc, 0) END AS tc FROM costed)")


def usage(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("model_name"), (F.floor(F.col("value") * 10) - 5).alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"), F.col("ts").cast("timestamp").alias("ts"))


def prices(spark):
    return spark.createDataFrame(list(PRICES), "model_name string, input_price_per_million_usd double, output_price_per_million_usd double")


def costed(spark, sf):
    return U.call_cost(usage(spark, sf), prices(spark), 93.0)


@query("usage_costs", f"""
WITH {COSTED} SELECT request_id, it AS input_tokens, ot AS output_tokens, round(ic * 1e6, 4) AS input_cost, round(oc * 1e6, 4) AS output_cost, round(tc * 1e6, 4) AS total, round(tc * 93 * 1e6, 4) AS converted FROM totals""")
def usage_costs(spark, sf):
    """Cost in millionths."""
    m = lambda c, n: F.round(F.col(c) * 1e6, 4).alias(n)
    return costed(spark, sf).select("request_id", "input_tokens", "output_tokens", m("input_cost_usd", "input_cost"), m("output_cost_usd", "output_cost"),
                                    m("total_cost_usd", "total"), m("total_cost", "converted"))


@query("usage_snapshot", f"""
WITH {COSTED} SELECT model_name, count(*) AS calls, sum(it)::BIGINT AS input_tokens, sum(ot)::BIGINT AS output_tokens, round(sum(tc) * 1e6, 2) AS total_cost,
  arg_max(request_id, (ts, request_id)) AS last_request_id FROM totals GROUP BY 1""")
def usage_snapshot(spark, sf):
    """I16."""
    return U.usage_snapshot(costed(spark, sf)).select("model_name", "calls", "input_tokens", "output_tokens", F.round(F.col("total_cost_usd") * 1e6, 2).alias(
        "total_cost"), "last_request_id")


@query("usage_history", f"WITH {COSTED} SELECT request_id, model_name, round(tc * 1e6, 4) AS total FROM totals ORDER BY ts DESC, request_id DESC LIMIT 100")
def usage_history(spark, sf):
    """I17."""
    return U.usage_history(costed(spark, sf)).select("request_id", "model_name", F.round(F.col("total_cost_usd") * 1e6, 4).alias("total"))


@query("usage_token_estimates", f"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN length(text)::INT ELSE {sql.est_tokens(sql.collapse('text'))} + {sql.est_tokens('role')} END AS tokens FROM conversations""")
def usage_token_estimates(spark, sf):
    """Reported for even turns, estimated for the others."""
    return table(spark, sf, "conversations").select("conv_id", "turn", U.usage_tokens(F.when(F.col("turn") % 2 == 0, F.length("text")), F.col("text"), F.col("role")).alias("tokens"))


def _catalogue(spark, sf):
    """Price catalogues, one for each user and hour, with a product per event."""
    ev = table(spark, sf, "events")
    sku = F.concat(F.lit("S"), "event_id")
    kind = F.when(F.col("event_id") % 2 == 0, "Input tokens").otherwise("Output tokens")
    attrs = F.create_map(F.lit("regionCode"), F.when(F.col("event_id") % 3 == 0, "eu").otherwise("us"), F.lit("model"), F.col("event_type"),
                         F.lit("inferenceType"), kind, F.lit("feature"), F.when(F.col("event_id") % 5 < 2, "On-demand Inference").otherwise("Batch"),
                         F.lit("service_tier"), F.when(F.col("event_id") % 7 < 4, "standard").otherwise("flex"))
    dim = F.struct(F.when(F.col("event_id") % 2 == 0, "price per 1K input tokens").otherwise("price per million tokens").alias("description"),
                   F.create_map(F.lit("USD"), F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("value").cast("string"))).alias("pricePerUnit"))
    term = F.create_map(sku.alias("t"), F.struct(F.create_map(F.lit("d"), dim).alias("priceDimensions")))
    return ev.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(F.struct(sku.alias("k"), F.struct(attrs.alias("attributes")).alias("v")))).alias("products"),
        F.struct(F.map_from_entries(F.collect_list(F.struct(sku.alias("k"), term.alias("v")))).alias("OnDemand")).alias("terms"))).alias("catalogue"))


_CAT = """cat AS (SELECT user_id, event_id, event_type AS model, event_id % 3 = 0 AS eu, event_id % 2 = 0 AS input, event_id % 5 < 2 AS od, event_id % 7 < 4 AS std,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN value * 1000 ELSE value END AS price FROM events)"""


@query("usage_price_candidates", f"""
WITH {_CAT} SELECT user_id AS catalogue_id, 'S' || event_id AS sku, round(price, 6) AS price_per_million_usd, CASE WHEN std THEN 3 ELSE 0 END + CASE WHEN od THEN 2 ELSE 0 END AS score
FROM cat WHERE price IS NOT NULL""")
def usage_price_candidates(spark, sf):
    """Products of nested catalogues with normalized prices."""
    return U.extract_prices(_catalogue(spark, sf), key="user_id").select(
        F.col("user_id").alias("catalogue_id"), "sku", F.round("price_per_million_usd", 6).alias("price_per_million_usd"), "score")


@query("usage_resolved_prices", f"""
WITH {_CAT}, ok AS (SELECT *, CASE WHEN std THEN 3 ELSE 0 END + CASE WHEN od THEN 2 ELSE 0 END AS s FROM cat WHERE NOT eu AND price IS NOT NULL AND (od OR std) AND model <> 'signup'),
b AS (SELECT model, input, arg_max(price, (s, 'S' || event_id)) AS p FROM ok GROUP BY 1, 2), l AS (SELECT model, max(p) FILTER (input) AS i, max(p) FILTER (NOT input) AS o FROM b GROUP BY 1)
SELECT m.event_type AS model_name, round(CASE WHEN l.model IS NOT NULL THEN l.i END, 6) AS input_price, round(CASE WHEN l.model IS NOT NULL THEN l.o END, 6) AS output_price,
  CASE WHEN l.model IS NOT NULL THEN 'live' ELSE 'unavailable' END AS status FROM (SELECT DISTINCT event_type FROM events) m LEFT JOIN l ON l.model = m.event_type""")
def usage_resolved_prices(spark, sf):
    """Best live price per model; one model has none."""
    live = U.best_prices(U.extract_prices(_catalogue(spark, sf), key="user_id").filter("model <> 'signup'"), "us")
    models = table(spark, sf, "events").select(F.col("event_type").alias("model_name"))
    out = U.resolve_prices(models, live, prices(spark))
    return out.select("model_name", F.round("input_price_per_million_usd", 6).alias("input_price"), F.round(
        "output_price_per_million_usd", 6).alias("output_price"), F.col("source_status").alias("status"))


# --- streams over the same tables ---------------------------------------------------------
def _run(spark, stream, mode, columns):
    """Run a stream to its end into a table of the shared folder; the last row per key counts."""
    base = session_dir(spark)
    _drain(stream, mode, base)
    return spark.read.parquet(base + "/out").select("epoch", *columns)


def _drain(stream, mode, base):
    """Run a stream over what is there; its checkpoint lets a later call go on from here.  A repeated epoch writes over itself."""
    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start()
    q.awaitTermination()


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_thread_state", f"""
WITH {_MSG}, g AS (SELECT thread_id, count(*) AS message_count, max(seq) AS last_seq, arg_max(content, seq) AS lc, arg_min(content, seq) FILTER (role = 'user') AS fu FROM messages GROUP BY 1)
SELECT thread_id::VARCHAR AS thread_id, message_count, last_seq, md5(lc) AS last_content, {_label('fu', 56)} AS title FROM g""")
def stream_thread_state(spark, sf):
    """I1 as a stream in four runs that go on from each other, turns out of order and conversations ending all along;
    it must end where the batch query does."""
    started, turn = F.coalesce("thread_id", F.lit(0)) * 600, F.coalesce("seq", F.lit(0)) * 60
    m = messages(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(86400) + started + turn))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("thread_id", "seq"), F.lit(1800))      # within the watermark
    m = store(m.withColumn("arrival", arrival))
    first, last = m.agg(F.min("arrival"), F.max("arrival")).first()
    share = (F.col("arrival") - (first or 0)) / ((last or 0) - (first or 0) + 1)
    base = session_dir(spark)
    for run in range(4):
        m.filter(F.floor(share * 4) == run).write.mode("append").parquet(base + "/in")
        _drain(jobs.thread_state_stream(spark.readStream.schema(m.schema).parquet(base + "/in"), idle="10 minutes"), "update", base)
    ended = jobs.merged_threads(spark.read.parquet(base + "/out"))
    return ended.withColumn("title", T.label(F.coalesce("title", F.lit("")))).withColumn("last_content", F.md5("last_content"))


@query("stream_ingest", f"""
WITH {inputs.LINES}
SELECT 'section' AS kind, '/q/' || doc_id AS source_path, order_index::INT AS order_index, md5(body) AS value FROM lines WHERE doc_id % 11 <> 10
UNION ALL SELECT 'dead', NULL, NULL, CASE WHEN doc_id % 11 = 10 AND doc_id % 2 = 0 THEN 'no source path' WHEN doc_id % 11 = 10 THEN 'not a message' ELSE 'no content' END FROM documents
WHERE doc_id % 11 = 10 OR text IS NULL""")
def stream_ingest(spark, sf):
    """Documents as JSON messages, some in base64, some broken, some sent twice, some after an older version and some
    before it, read in several micro-batches; sections and dead letters must be those of the documents."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    base, c = session_dir(spark), F.col("doc_id")

    def sent(docs, text, at, shift):
        b64 = c % 3 == 0
        body = F.when(b64, F.base64(F.encode(text, "UTF-8"))).otherwise(text)
        message = F.to_json(F.struct(body.alias("content"), F.when(b64, "base64").alias("encoding"), F.lit(at).alias("sent_at"), F.when(
            c % 11 != 10, F.concat(F.lit("/q/"), c)).alias("source_path")))
        value = F.when((c % 11 == 10) & (c % 2 != 0), F.concat(F.lit("broken "), c)).otherwise(message)
        return docs.select(value.alias("value"), F.pmod(F.xxhash64("doc_id") + shift, F.lit(1 << 20)).alias("arrival"))
    fine = d.filter((c % 11 != 10) & F.col("text").isNotNull())
    now, old = "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"
    everything = sent(d, F.col("text"), now, 0).unionByName(sent(fine.filter(c % 5 == 0), F.col("text"), now, 400_000)).unionByName(
        sent(fine.filter(c % 4 == 0), F.concat(F.lit("older line\n"), "text"), old, 600_000))
    files = max(8, 2 * d.rdd.getNumPartitions())
    everything.repartition(files, "arrival").select("value").write.text(base + "/in")
    jobs.ingest_stream(M.read_messages(spark, base + "/in", -(-files // 4)), base + "/out", base + "/checkpoint", line_sections).awaitTermination()
    sections = jobs.ingested(spark, base + "/out", "sections").select(
        F.lit("section").alias("kind"), "source_path", "order_index", F.md5("body").alias("value"))
    return sections.unionByName(jobs.ingested(spark, base + "/out", "dead").select(
        F.lit("dead").alias("kind"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("int").alias("order_index"), F.col("error").alias("value")))


@query("stream_usage_totals", f"""
WITH {COSTED} SELECT date_trunc('hour', ts) AS hour, model_name, count(*) AS calls, sum(it)::BIGINT AS input_tokens, round(sum(tc) * 1e6, 2) AS total_cost FROM totals GROUP BY 1, 2""")
def stream_usage_totals(spark, sf):
    """I16 as a stream of hourly totals."""
    ev = _stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("model_name"), (F.floor(F.col("value") * 10) - 5).alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"), F.col("ts").cast("timestamp").alias("ts"))
    out = _run(spark, jobs.usage_totals_stream(U.call_cost(ev, prices(spark))), "update", ["window", "model_name", "calls", "input_tokens", "total_cost_usd"])
    last = out.groupBy(F.col("window.start").alias("hour"), "model_name").agg(F.max_by(F.struct("calls", "input_tokens", "total_cost_usd"), "epoch").alias("s"))
    return last.select("hour", "model_name", "s.calls", "s.input_tokens", F.round(F.col("s.total_cost_usd") * 1e6, 2).alias("total_cost"))


@query("stream_first_questions", """
SELECT DISTINCT event_type || ' q' || (user_id % 3) AS question FROM events WHERE event_id % 10 <> 0""")
def stream_first_questions(spark, sf):
    """I12 as a stream: one question per key within its lifetime (one micro-batch holds all keys here)."""
    ev = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit(" Q"), F.col("user_id") % 3).alias("question"),
                                             F.array(F.lit("a")).alias("active_docs"), (F.col("event_id") % 10 == 0).alias("context_dependent"))
    return _run(spark, jobs.first_questions(ev), "append", ["question"]).select(F.lower("question").alias("question")).distinct()
