"""Joins, state, search and streams on small tables against values worked out by hand or by brute force."""
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import access as A, conversation as C, evaluation as V, sections as SE, usage as U
from lectern.plans import common, search as S
from lectern.sources import files, messages
from lectern.streaming import jobs

AT = "2024-01-01"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_access_scenario(spark):
    none = spark.createDataFrame([], "user_id string, doc_id string, granted_at timestamp")
    users = spark.range(100, 110).toDF("user_id")
    docs = lambda *d: spark.createDataFrame([(x,) for x in d], "doc_id string")
    g = A.grant(none, users, docs("alpha"), AT)
    g = A.grant(g, users.filter("user_id % 2 = 0"), docs("beta"), AT)
    g = A.grant(g, users, docs("alpha"), AT)
    assert g.count() == 15
    g = A.grant_admin(g, users.filter("user_id = 109"), AT)
    g = A.revoke(g, spark.createDataFrame([("101", "alpha"), ("999", "alpha")], "user_id string, doc_id string"))
    asked = spark.createDataFrame([("101",), ("102",), ("103",), ("109",), ("77",)], "user_id string")
    assert rows(A.accessible(g, asked)) == [("101", False, 0), ("102", False, 2), ("103", False, 1), ("109", True, 1), ("77", False, 0)]
    hits = asked.crossJoin(docs("alpha", "beta"))
    assert rows(A.visible(hits, g)) == [("102", "alpha"), ("102", "beta"), ("103", "alpha"), ("109", "alpha"), ("109", "beta")]
    assert A.revoke_document(g, docs("alpha")).filter("doc_id = 'alpha'").count() == 0


def test_costs(spark):
    usage = spark.createDataFrame([("r1", "m", 1200, 300, 1), ("r2", "m", -5, 10, 2), ("r3", "x", 1, 1, 3)],
                                  "request_id string, model_name string, input_tokens int, output_tokens int, ts int")
    prices = spark.createDataFrame([("m", 2.0, 8.0)], "model_name string, input_price_per_million_usd double, output_price_per_million_usd double")
    got = {r.request_id: r for r in U.call_cost(usage, prices, 93.0).collect()}
    assert math.isclose(got["r1"].input_cost_usd, 0.0024) and math.isclose(got["r1"].output_cost_usd, 0.0024)
    assert math.isclose(got["r1"].total_cost, 0.4464) and got["r2"].input_tokens == 0 and got["r3"].total_cost_usd is None


def test_catalogue_prices(spark):
    doc = ('{"products": {"A": {"attributes": {"regionCode": "us", "model": "m", "inferenceType": "Input tokens", "feature": "On-demand Inference"}}},'
           '"terms": {"OnDemand": {"A": {"t": {"priceDimensions": {"d": {"description": "0.00008 per 1K input tokens", "pricePerUnit": {"USD": "0.00008"}}}}}}}}')
    got = U.extract_prices(spark.createDataFrame([(1, doc)], "catalogue_id int, catalogue string")).first()
    assert math.isclose(got.price_per_million_usd, 0.08) and got.score == 2


def test_prices_meet_their_own_terms(spark):
    def catalogue(prices, extra):
        term = lambda usd: {"t": {"priceDimensions": {"d": {"description": "per million", "pricePerUnit": {"USD": usd}}}}}
        return json.dumps({"products": {k: {"attributes": {"model": k.lower()}} for k in [*prices, "NONE"]},
                           "terms": {"OnDemand": {k: term(v) for k, v in {**extra, **prices}.items()}}})
    df = spark.createDataFrame([
        (1, catalogue({"C": "3", "A": "1", "B": ""}, {"AA": "9", "0": "9"})), (1, catalogue({"A": "7"}, {})), (None, catalogue({"A": "5"}, {"NON": "9"})),
        (2, '{"products": {}}'), (3, "{}"), (4, None), (5, "broken"), (6, '{"products": {"A": {"attributes": {}}}}')], "catalogue_id int, catalogue string")
    got = U.extract_prices(df).select("catalogue_id", "sku", "model", "price_per_million_usd")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "A", "a", 1.0), (1, "C", "c", 3.0), (1, "A", "a", 7.0), (None, "A", "a", 5.0)], key=str)


def test_folder_and_export_round_trip(spark, tmp_path):
    texts = ['a "quoted", line\r\nand\nmore ', " lead", "", None, "back\\slash \\\"", "ä\u2028ö\t", "#c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files.export_csv(df, str(tmp_path / "csv"))
    assert dict(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == dict(enumerate(texts))
    files.write_lines(df, str(tmp_path / "lines"), 2)
    (tmp_path / "lines" / "x_summary.txt").write_text("generated")
    (tmp_path / "lines" / "x.zip").write_text("other")
    found = files.read_documents(spark, str(tmp_path / "lines")).select("source_path", "text")
    assert found.count() >= 4
    assert dict(map(tuple, files.read_lines(found, "doc_id long, text string").select("doc_id", "text").collect())) == dict(enumerate(texts))


def test_previous_pair_over_blocks(spark):
    turns = [(0, i, "user" if i % 3 == 0 else "assistant", f"m{i}") for i in range(40)]
    df = spark.createDataFrame(turns, "thread_id long, seq long, role string, content string")
    asked = C.last_before(df, "thread_id", "seq", F.when(F.col("role") == "user", F.col("content")), "q", block=4)
    got = {r.seq: r.q for r in asked.collect()}
    assert all(got[i] == (f"m{(i - 1) // 3 * 3}" if i else None) for i in range(40))


def test_clarification_resumes(spark):
    turns = [(1, 0, "Can I apply", True, False), (1, 1, "hmm?", True, False), (1, 2, "Role: Agent", True, False), (1, 3, "Can I get it", True, False),
             (2, 0, "vague", False, True), (2, 1, "travel policy", False, True)]
    got = C.resume_questions(spark.createDataFrame(turns, "thread_id long, seq long, content string, ask_profile boolean, ask_question boolean"))
    assert rows(got) == [(1, 0, "Can I apply", "ask_profile"), (1, 1, "Can I apply", "retry_profile"), (1, 2, "Can I apply", "resumed"),
                         (1, 3, "Can I get it", "search"), (2, 0, "vague", "ask_question"), (2, 1, "vague travel policy", "resumed")]


def test_answer_cache_lifetime(spark):
    data = [(1, 0, True), (2, 1800, True), (3, 3700, True), (4, 3800, True), (5, 20000, False), (6, 20010, True), (7, 20020, True)]
    log = spark.createDataFrame(data, "query_id long, s long, answerable boolean").select(
        "query_id", F.timestamp_seconds("s").alias("ts"), F.lit("Q").alias("question"), F.array(F.lit("d")).alias("active_docs"),
        F.lit(False).alias("context_dependent"), "answerable")
    assert [(r.query_id, r.hit) for r in C.answer_cache(log).orderBy("query_id").collect()] == [
        (1, False), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True)]


@pytest.mark.parametrize("seed, lifetimes, batch", [(1, 2, 10000), (2, 3, 7), (3, 64, 5), (4, 2, 1)])
def test_answer_cache_against_a_plain_loop(spark, seed, lifetimes, batch):
    """One key holds half the log; blocks, their steps and the scan go over several batches; times tie, some are null."""
    rng = random.Random(seed)
    data = [(i, rng.randrange(30) * 7 if rng.random() < 0.2 else rng.randrange(4000), rng.choice(["Hot", "Hot", "Hot", "a", "b", "c"]),
             rng.choice([True, True, False, None]), rng.random() < 0.1) for i in range(1500)]
    data += [(9000, None, "Hot", True, False), (9001, 5, None, True, False)]
    log = spark.createDataFrame(data, "query_id long, s long, question string, answerable boolean, context_dependent boolean").select(
        "query_id", F.timestamp_seconds("s").alias("ts"), "question", F.array(F.lit("d")).alias("active_docs"), "context_dependent", "answerable")
    want, stored = [], {}
    for i, t, q, ok, skip in sorted((d for d in data if d[1] is not None), key=lambda d: (d[1], d[0])):
        if not skip:
            hit = t - stored.get(q, -10**9) <= 100
            want.append((i, hit))
            if not hit and ok:
                stored[q] = t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(C.answer_cache(log, 100, lifetimes=lifetimes).select("query_id", "hit"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)
    assert rows(C.answer_cache(log.limit(0), 100)) == []


def test_upsert_and_faq_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(files.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id")) == [(1, "a"), (2, "c"), (3, "d")]
    docs = spark.createDataFrame([(5, [("q1", "a1"), ("q2", "a2")], [[1.0]])], "doc_id int, faq_pairs array<struct<question:string,answer:string>>, faq_vectors array<array<double>>")
    assert [r.faq_id for r in files.faq_rows(docs).collect()] == ["5_faq_0"]


def test_folder_scan(spark, tmp_path):
    for name, data in (("a.txt", b"hello \xff"), ("b.HTML", b"<p>x</p>"), ("c_faq.txt", b"no"), ("d.xyz", b"no")):
        (tmp_path / name).write_bytes(data)
    got = files.read_documents(spark, str(tmp_path)).select("content_type", "text")
    assert rows(got) == [("html", "<p>x</p>"), ("text", "hello ")]


def corpus(spark, n=60):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "hot"]
    data = [(f"s{i:03d}", i % 20, "hot " + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return data, spark.createDataFrame(data, "section_id string, doc_id long, body string")


def test_keyword_search_against_brute_force(spark):
    data, df = corpus(spark)
    questions = spark.createDataFrame([(1, "alpha hot"), (2, "delta omega beta")], "query_id long, question string")
    ix = S.build_index(df, ("body",))
    docs = {s: b.split() for s, _, b in data}
    avg = sum(map(len, docs.values())) / len(docs)
    want = {}
    for q, text in ((1, "alpha hot"), (2, "delta omega beta")):
        scores = {}
        for term in set(text.split()):
            df_n = sum(term in d for d in docs.values())
            idf = math.log(1 + (len(docs) - df_n + 0.5) / (df_n + 0.5))
            for s, d in docs.items():
                tf = d.count(term)
                if tf:
                    scores[s] = scores.get(s, 0) + idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        want[q] = sorted(((-round(v, 9), s) for s, v in scores.items()))[:10]
    for options in ({}, {"small": False, "max_broadcast": 0, "hot_rows": 7}):
        got = S.keyword_search(questions, ix, 10, {"body": 1.0}, **options)
        for q in want:
            assert [r.section_id for r in got.filter(f"query_id = {q}").orderBy("rank").collect()] == [s for _, s in want[q]]


def test_blocks_score_without_a_shuffle(spark):
    _, df = corpus(spark)
    questions = spark.createDataFrame([(1, "alpha hot")], "query_id long, question string")
    ix = S.build_index(df, ("body",), blocks=4)
    scored = S._scored(S._pairs(ix, S.keyword_terms(questions, ix, {"body": 1.0}), small=True), ["body"])
    assert "Exchange hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()


def test_vectors_with_copies_and_blocks(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    data = [(f"v{i:03d}", i % 7, base[0] if i % 3 == 0 else base[i % 10]) for i in range(90)]      # a third are copies
    s = spark.createDataFrame(data, "section_id string, doc_id long, vector array<double>")
    q = spark.createDataFrame([(1, base[0]), (2, base[4]), (3, [])], "query_id long, vector array<double>")
    one = rows(S.vector_search(q, s, 5).select("query_id", "rank", "section_id"))
    two = rows(S.vector_search(q, s, 5, max_query_values=0, block_rows=13, block_queries=1).select("query_id", "rank", "section_id"))
    assert one == two and [r[2] for r in one if r[0] == 1] == ["v000", "v003", "v006", "v009", "v010"] and not [r for r in one if r[0] == 3]


def test_fuzzy_terms_against_brute_force(spark):
    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]
    rng = random.Random(9)
    vocab = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(120)})
    df = spark.createDataFrame([(v,) for v in vocab], "term string")
    want = sorted((a, b, edits(a, b)) for a in vocab for b in vocab if edits(a, b) <= (0 if len(a) <= 2 else 1 if len(a) <= 5 else 2))
    assert rows(S.fuzzy_terms(df, df).select("term", "match", "distance")) == want


@pytest.mark.parametrize("most", [common.PHRASES, 3])
def test_substring_join_against_brute_force(spark, most):
    """By the automaton and by grams; phrases inside each other, repeated, with one head, in other scripts; nulls and empties."""
    texts = [(1, "the hot path of the cat"), (2, "scattered cats"), (3, "a longer sentence with twenty five letters in it"),
             (4, ""), (5, None), (6, "aaaa 𝔘nicode ß \x00 tail"), (7, "cat " * 5000)]
    phrases = ["cat", "a", "th", "hot path", "twenty five letters in it", "none", "aa", "𝔘ni", "ß \x00", "cat cat", "", None, "cat", "twenty five letters in a"]
    data = [(p, i) for i, p in enumerate(phrases)]
    got = common.substring_join(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame(data, "p string, n int"), "p", most)
    assert rows(got.select("k", "p", "n")) == sorted((k, p, n) for k, t in texts for p, n in data if t and p and p in t)
    assert rows(common.substring_join(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([], "p string, n int"), "p", most)) == []


def test_order_statistics_and_comparison(spark):
    values = [float(x) for x in (5, 1, 3, 3, 9, 7, 7, 7, 2, 8)]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms double")
    assert tuple(V.exact_elements(df, "latency_ms", (0.5, 0.95)).first()) == (sorted(values)[5], sorted(values)[9])
    run = lambda h: spark.createDataFrame([(i, x, 1.0 if x else 0.0, "") for i, x in enumerate(h)], "id int, hit_at_1 boolean, reciprocal_rank double, error string")
    r = V.compare_runs(run([True, False, True]), run([True, True, False])).first()
    assert (r.common, r.regressions, r.improvements, r.hit_at_1_delta) == (3, 1, 1, 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_order_statistics_of_skewed_values(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, 1e-9, 3.5, 1e12, -7.25, rng.random(), rng.gauss(0, 1) * 1e6]) for _ in range(997 + seed)] + [2.0] * 400
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 50, "x double").repartition(7)
    shares = (0.0, 0.25, 0.5, 0.95, 0.999)
    got = tuple(V.exact_elements(df, "x", shares, buckets=8).first())
    assert got == tuple(sorted(values)[int(len(values) * s)] for s in shares)
    assert tuple(V.exact_elements(df.filter("x is null"), "x", (0.5,)).first()) == (None,)


def reduce_all(parts, budget, floor, keep):
    """The rounds of a reduction, one text at a time, and how many there were."""
    tokens = lambda t: 0 if not t.strip() else max(1, -(-len(t.strip()) // 4), int(len(t.split()) * 1.3))
    show = lambda ps: "\n\n".join(f"Partial summary {i}:\n{p}" for i, p in enumerate(ps, 1))
    now, effective, rounds = [p.strip() for p in parts if p.strip()], max(budget, floor), 0
    while True:
        rounds += 1
        if len(now) < 2:
            return (now or [""])[0], rounds
        if tokens(show(now)) <= effective:
            return keep(show(now)), rounds
        limit, batches, size = max(floor, effective // 2), [], 0
        for p in now:
            n = tokens("Partial summary:\n" + p)
            if batches and size + n + 12 <= limit:
                batches[-1].append(p)
                size += n + 12
            else:
                batches.append([p])
                size = n
        if len(batches) <= 1:
            batches = [[p] for p in now]
        after = [b[0] if len(b) == 1 else keep(show(b)) for b in batches]
        if after == now:
            return show(now), rounds
        now, effective = [p.strip() for p in after if p.strip()], limit


def test_reductions_go_on_until_nothing_is_left_to_do(spark):
    rng = random.Random(2)
    word = lambda n: " ".join("x" * rng.randint(1, 6) for _ in range(n))
    data = [(0, []), (1, [" "]), (2, ["one"]), (3, ["a", " ", "b"]), (4, [word(60) for _ in range(1500)]), (5, [word(3000), word(2000)]),
            (6, [word(rng.randint(1, 90)) for _ in range(300)]), (7, None), (8, ["a short text here"] * 400)]
    df = spark.createDataFrame([(i, p, "extra") for i, p in data], "i int, p array<string>, reduced_by string")
    got = {r.i: r.reduced for r in SE.plan_reduction(df, "p", 120, 60, combine=lambda t: F.substring(t, 1, 40)).collect()}
    want = {i: reduce_all(p or [], 120, 60, lambda t: t[:40]) for i, p in data}
    assert got == {i: t for i, (t, _) in want.items()}
    assert max(n for _, n in want.values()) > 6


def test_messages_and_dead_letters(spark):
    raw = ['{"content": "aGk=", "encoding": "base64", "source_path": "/a"}', '{"content": "x"}', "not json", '{"content": "y", "source_path": "/b"}']
    parsed = messages.parse_messages(spark.createDataFrame([(r,) for r in raw], "value string"))
    assert rows(messages.accepted(parsed).select("source_path", "text")) == [("/a", "hi"), ("/b", "y")]
    assert messages.dead_letters(parsed).count() == 2


def test_stream_threads_expire_and_come_back(spark, tmp_path):
    """Shuffled arrival over four runs: threads end, one speaks again after its state is gone, state shrinks, parts add up."""
    day, fields = 86400, "thread_id string, seq long, role string, content string, ts timestamp"
    runs = [[("a", 2, "user", "second", 120), ("a", 1, "user", "first", 60), ("b", 0, "assistant", "hi", 70)],
            [("a", 0, "system", "rules", 10), ("c", 0, "user", None, 9000), ("c", None, "user", "unplaced", 9010)],
            [("a", 3, "user", "back again", 20000), ("b", 1, "user", "me too", 20010), ("d", 0, "user", "late start", 21000)],
            [("d", 1, "assistant", "last", 90000), ("a", 4, "user", "lost: behind the watermark", 20001)]]
    live, base = [], str(tmp_path)                        # rows of state after each run, timers included

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
    for part in runs:
        spark.createDataFrame(part, fields.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds(F.col("s") + day)).drop(
            "s").coalesce(1).write.mode("append").parquet(base + "/in")
        q = jobs.thread_state_stream(spark.readStream.schema(fields).parquet(base + "/in"), "10 minutes", "30 minutes").writeStream.outputMode(
            "update").foreachBatch(write).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        live.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    out = spark.read.parquet(base + "/out")
    assert out.filter("closed").groupBy("thread_id").count().filter("thread_id = 'a'").first()["count"] == 2     # two parts, both over
    assert live[0] > 0 and live[3] < max(live) and live[3] <= live[0], live
    # as the batch query over the same messages, but for the one behind the watermark
    assert sorted(map(tuple, jobs.merged_threads(out).collect())) == [
        ("a", 4, 3, "first", "back again"), ("b", 2, 1, "me too", "me too"), ("c", 2, 0, None, None), ("d", 2, 1, "late start", "last")]


def test_stream_ingest_of_repeated_and_late_epochs(spark, tmp_path):
    """Small batches, a message that comes again, an older version after a newer one, an epoch that broke off and one that repeats."""
    base = str(tmp_path)
    line = lambda path, text, day: json.dumps({"content": text, "source_path": path, "sent_at": f"2024-01-0{day}T00:00:00Z"})
    sent = [[line("/a", "new\nlines", 3), "broken", line("/b", "b", 1)], [line("/a", "old", 1), line("/a", "new\nlines", 3)], [line("/b", "b again", 2), '{"source_path": "/x"}']]

    def go(checkpoint):
        q = jobs.ingest_stream(messages.read_messages(spark, base + "/in", 1), base + "/out", base + checkpoint, SE.line_sections)
        q.awaitTermination()
        return str(q.id)

    def bodies():
        return rows(jobs.ingested(spark, base + "/out", "sections").select("source_path", "body"))
    want = [("/a", "lines"), ("/a", "new"), ("/b", "b again")]
    for part in sent:
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(base + "/in")
    stream = go("/cp")
    assert bodies() == want and jobs.ingested(spark, base + "/out", "manifest").count() == 3
    assert rows(jobs.ingested(spark, base + "/out", "dead").select("error")) == [("no content",), ("not a message",)]
    # an epoch whose files were written before the driver was lost, without its row of the manifest, is not seen
    jobs.ingested(spark, base + "/out", "documents").drop("stream", "epoch").withColumn("text", F.lit("half")).withColumn(
        "version", F.current_timestamp()).write.parquet(f"{base}/out/documents/stream={stream}/epoch=3")
    assert bodies() == want
    # the next batch takes that epoch's number and writes over it
    spark.createDataFrame([(line("/c", "c", 1),)], "value string").coalesce(1).write.mode("append").text(base + "/in")
    assert go("/cp") == stream and bodies() == [*want, ("/c", "c")]
    # the commit of an epoch is lost: it comes again and changes nothing
    os.remove(f"{base}/cp/commits/3")
    if os.path.exists(f"{base}/cp/commits/.3.crc"):
        os.remove(f"{base}/cp/commits/.3.crc")
    go("/cp")
    assert bodies() == [*want, ("/c", "c")] and jobs.ingested(spark, base + "/out", "manifest").count() == 4
    # another stream over the same messages into the same tables adds nothing
    assert go("/cp2") != stream and bodies() == [*want, ("/c", "c")]


def test_vector_search_keeps_text_ids(spark, monkeypatch):
    monkeypatch.setattr(S, "SCORES", 5)                  # several slices of questions
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    qs, ss = {f"q{i}": vec() for i in range(7)}, {f"{i:x}" * 8: vec() for i in range(12)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = sorted((q, s, "d" + s) for q, a in qs.items() for s in sorted(ss, key=lambda s: -cos(a, ss[s]))[:3])
    q = spark.createDataFrame([(k, v, "u") for k, v in qs.items()], "query_id string, vector array<double>, user_id string")
    s = spark.createDataFrame([(k, "d" + k, v) for k, v in ss.items()], "section_id string, doc_id string, vector array<double>")
    grants = spark.createDataFrame([("u", "d" + k) for k in ss], "user_id string, doc_id string")
    for got in (S.vector_search(q, s, 3), S.vector_search(q, s, 3, max_query_values=1), S.vector_search(q, s, 3, grants)):
        assert rows(got.select("query_id", "section_id", "doc_id")) == want


def test_grant_in_cells(spark):
    none = spark.createDataFrame([], "user_id string, doc_id string, granted_at timestamp")
    users = spark.createDataFrame([(i,) for i in range(7)] * 2, "user_id int")
    docs = spark.createDataFrame([(i,) for i in range(11)], "doc_id int")
    got = A.grant(none, users, docs, "2024-01-01", cell_rows=2)
    assert rows(got.select("user_id", "doc_id")) == sorted((str(u), str(d)) for u in range(7) for d in range(11))


def test_bulk_grant_counts(spark):
    old = spark.createDataFrame([("1", "a", "2023-01-01"), ("1", "x", "2025-01-01"), ("1", "b", "2025-01-01"), ("2", "*", AT),
                                 ("9", "a", AT)], "user_id string, doc_id string, granted_at string").withColumn(
        "granted_at", F.col("granted_at").cast("timestamp"))
    users, docs = spark.range(1, 4).toDF("user_id"), spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "doc_id string")
    full = A.grant(old, users, docs, AT)
    want = full.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("granted_at") == F.lit(AT).cast("timestamp")))
    assert rows(A.bulk_counts(old, users, docs, AT)) == rows(want) == [("1", 4, 2), ("2", 4, 4), ("3", 3, 3), ("9", 1, 1)]
    many = A.bulk_counts(old, spark.range(1, 200_001).toDF("user_id"), spark.range(50_000).toDF("doc_id"), AT)
    assert many.agg(F.sum("n_grants")).first()[0] == 200_000 * 50_000 + 5         # ten thousand million grants, never rows


def counted(df):
    """The same rows, and a counter of how many of them were computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), seen


def test_injected_documents_look_up_once(spark):
    hits = spark.createDataFrame([(1, "a#0", "a", 0.5, 1), (2, "b#1", "b", 0.4, 1)], "query_id long, section_id string, doc_id string, score double, rank int")
    lookups, seen = counted(spark.createDataFrame([(1, "c", 0.9), (2, "c", 0.1)], "query_id long, doc_id string, lookup_score double"))
    sections = spark.createDataFrame([("c", "c#0", 0), ("c", "c#1", 1), ("b", "b#1", 1)], "doc_id string, section_id string, order_index int")
    got = S.inject_document(hits, lookups, sections)
    assert rows(got) == [(1, "c#0", "c", 1.0, 1), (1, "c#1", "c", 1.0, 2), (2, "b#1", "b", 0.4, 1)] and seen.value == 2


def test_cases_and_runs_are_computed_once(spark):
    cases, seen = counted(spark.createDataFrame([(1, "Leave", ""), (2, "Travel", "")], "id long, source_document string, source_section string"))
    hits = spark.createDataFrame([(1, 1, "Claims", "x"), (1, 2, "Leave", "x"), (2, 1, "Travel", "x")],
                                 "id long, rank int, document_title string, section_title string")
    scored = V.score_cases(cases, hits).select("id", "got", "hit_at_1", "hit_at_3", "reciprocal_rank")
    assert rows(scored) == [(1, "Claims", False, True, 0.5), (2, "Travel", True, True, 1.0)] and seen.value == 2
    run, seen = counted(scored.withColumn("error", F.lit("")))
    assert V.compare_runs(run, scored.withColumn("error", F.lit(""))).first().common == 2 and seen.value == 2


def test_dual_sections_read_their_hits_once(spark):
    from lectern.operators import decisions as D

    hits, seen = counted(spark.createDataFrame([(1, f"{d}#0", d, 0.5, n + 1) for n, d in enumerate("abcdefg")],
                                               "query_id long, section_id string, doc_id string, score double, rank int"))
    duals = spark.createDataFrame([(1, "b", "z")], "query_id long, doc_a string, doc_b string")
    got = D.dual_sections(duals, hits).select("side", "section_id")
    assert rows(got) == [("A", "b#0"), ("B", "d#0"), ("B", "e#0"), ("B", "f#0")] and seen.value == 7


def test_full_sections_return_title_terms_and_counts(spark, tmp_path):
    from lectern.suite import metadata_queries

    spark.createDataFrame([(1, "en", "web", "Leave policy\nleave leave days 12")], "doc_id long, lang string, source string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    got = metadata_queries.meta_full_sections(spark, str(tmp_path)).filter("section_id = '1#1'").first()
    assert got.title_terms == "line|2|line_2"
    pieces = ["Line 2", "Leave policy", *got.tags.split("|"), "leave leave days 12"]
    counts = {}
    for words in ([w for w in p.lower().split()] for p in pieces):
        for term in words + list(map("_".join, zip(words, words[1:]))):
            counts[term] = counts.get(term, 0) + 1
    assert json.loads(got.token_counts) == counts and got.token_length == sum(counts.values())
