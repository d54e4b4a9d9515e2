"""Block scoring, access classes, near words and stems against brute force."""
import itertools
import math
import random

import pytest

from lectern.functions import stemming
from lectern.operators import access as A
from lectern.plans import cells, search as S
from lectern.plans import spelling

STEMS = dict(zip(*[iter("""
consigned consign consignment consign consistency consist consistently consist consolations consol consolatory consolatori
consolidating consolid conspicuously conspicu conspiracy conspiraci conspirators conspir constance constanc knackeries
knackeri kneading knead knees knee knife knife knightly knight knitted knit knives knive knocker knocker caresses caress
ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoping hope by by say
say agreed agre feed feed dying die skies sky news news proceed proceed generically generic communication communic
arsenal arsenal rational ration relational relat digitizer digit decisiveness decis callousness callous sensibility
sensibl triplicate triplic electrical electr reviv reviv adjustable adjust replacement replac adoption adopt effective
effect probate probat rate rate controll control roll roll youth youth enjoying enjoy flying fli early earli fully fulli
geology geolog é é 日本 日本 x x ab ab
""".split())] * 2))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stems_of_the_published_vocabulary(spark):
    df = spark.createDataFrame([(w,) for w in STEMS] * 2, "term string")
    assert {r.word: r.stem for r in stemming.stem_words(df).collect()} == STEMS


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghij"])
def test_near_words(spark, letters):
    rng = random.Random(letters)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 11))) for _ in range(160)})
    words += [w[:i] + w[i + 1:] for w in words[::7] for i in (0, len(w) // 2) if len(w) > 3] + [w + "z" for w in words[::5]]
    df = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "term string")
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = sorted((a, b, edits(a, b)) for a, b in itertools.product(set(words), repeat=2) if edits(a, b) <= allowed(a))
    assert rows(spelling.near_words(df, df).select("term", "match", "distance")) == want


def test_near_words_of_very_long_tokens(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(5000))
    df = spark.createDataFrame([(long,), (long[:2000] + "x" + long[2001:],), (long[1:],), ("",), (None,)], "term string")
    got = spelling.near_words(df, df).select("term", "match", "distance").collect()
    assert sorted(r.distance for r in got) == sorted([0, 0, 0, 1, 1, 1, 1, 2, 2])


def library(n=240, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(f"s{i:03d}", i % 17, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(n)] + [
        (f"t{i:03d}", 5, "hot w1 w2") for i in range(n // 2)]                                      # a third are copies


def brute(sections, text, k, may=lambda d: True):
    docs = {s: (d, t.split()) for s, d, t in sections}
    avg = sum(len(w) for _, w in docs.values()) / len(docs)
    scores = {}
    for term in set(text.split()):
        df = sum(term in w for _, w in docs.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for s, (d, w) in docs.items():
            if term in w and may(d):
                tf = w.count(term)
                scores[s] = scores.get(s, 0) + idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return [s for _, s in sorted((-round(v, 9), s) for s, v in scores.items())][:k]


@pytest.fixture(scope="module")
def world(spark):
    data = library()
    questions = [(1, "hot w1", "ann"), (2, "w3 w4 w5 w6 w7 w8", "bob"), (3, "w9", "cat"), (4, "nothing here", "ann"),
                 (5, "w1 w2 w3", "root"), (6, "w1 w2 w3", "dan"), (7, "w11 w12 w1", "eve"), (8, "w1", None)]
    grants = [("ann", str(d)) for d in (1, 2, 3)] + [("eve", str(d)) for d in (3, 2, 1, 1)] + [("bob", "5"), ("root", "*"), ("root", "1"),
                                                                                               ("dan", "99")]
    return (data, questions, spark.createDataFrame(data, "section_id string, doc_id long, body string"),
            spark.createDataFrame(questions, "query_id long, question string, user_id string"),
            spark.createDataFrame(grants, "user_id string, doc_id string"))


@pytest.mark.parametrize("blocks", [1, 4, 24])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_thresholds_lose_nothing(spark, world, blocks, k):
    data, questions, df, q, _ = world
    ix = S.build_index(df, ("body",), blocks=blocks)
    got = S.keyword_search(q, ix, k, {"body": 1.0}).collect()
    for n, text, _ in questions:
        assert [r.section_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == n] == brute(data, text, k)


def test_pairs_sent_are_a_multiple_of_k(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(f"s{i}", i, " ".join(rng.choice(words) for _ in range(12))) for i in range(4000)],
                               "section_id string, doc_id long, body string")
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 30))) for i in range(20)], "query_id long, question string")
    ix = S.build_index(df, ("body",), blocks=16)
    report = {}
    S.threshold_top(ix, S.keyword_terms(q, ix, {"body": 1.0}), 5, ["body"], report=report)
    assert report["matching"] > 20 * 1000 and report["sent"] <= 20 * 5 * 24


@pytest.mark.parametrize("most", [S.ROUND_ROWS, 4])
def test_a_large_question_table_moves_no_postings(spark, world, monkeypatch, most):
    """Questions come in rounds, however often a term occurs; only the first k of a question are shuffled."""
    monkeypatch.setattr(S, "ROUND_ROWS", most)
    data, questions, df, q, grants = world
    ix = S.build_index(df, ("body",), blocks=5)
    large, plans, kept = {"small": False, "max_broadcast": 0, "hot_rows": 5}, [], S.store
    monkeypatch.setattr(S, "store", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kept(rows))
    got = S.keyword_search(q, ix, 6, {"body": 1.0}, **large).collect()
    for n, text, _ in questions:
        assert [r.section_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == n] == brute(data, text, 6)
    answers = [p for p in plans if "section_id" in p]
    assert len(answers) >= (2 if most > 4 else 5)
    for p in answers:
        assert "hashpartitioning(field" not in p and "hashpartitioning(query_id" in p
        assert not [line for line in p.split("\n") if "Exchange hashpartitioning" in line and "section_id" in line]
    for options in ({"grants": grants}, {"within": df.filter("doc_id < 9")}):
        one, two = (rows(S.keyword_search(q, ix, 6, {"body": 1.0}, **options, **how).select("query_id", "rank", "section_id", "score"))
                    for how in ({}, large))
        assert one == two and one
    one, two = (rows(S.similarity_search(q, ix, 4, fields=("body",), **how).select("query_id", "rank", "section_id")) for how in ({}, large))
    assert one == two and one


def test_many_near_words_move_no_postings(spark, world, monkeypatch, request):
    """near words make a large question table of a small one; it is answered in rounds as well."""
    _, _, df, q, _ = world
    ix = S.build_index(df, ("body",), blocks=5)
    want = rows(S.keyword_search(q, ix, 6, {"body": 1.0}, fuzzy=True).select("query_id", "rank", "section_id", "score"))
    plans, kept, small = [], S.store, S.is_small
    monkeypatch.setattr(S, "is_small", lambda rows, *most: "w" not in rows.columns and small(rows, *most))
    monkeypatch.setattr(S, "store", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kept(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)               # as for a table that Spark would not broadcast
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    got = S.keyword_search(q, ix, 6, {"body": 1.0}, fuzzy=True)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert rows(got.select("query_id", "rank", "section_id", "score")) == want and want
    moved = [line for p in plans for line in p.split("\n") if "Exchange hashpartitioning" in line and "section_id" in line]
    assert not moved


def test_hidden_sections_are_never_scored(spark, world):
    data, questions, df, q, grants = world
    may = {"ann": {1, 2, 3}, "eve": {1, 2, 3}, "bob": {5}, "dan": {99}}
    ix = S.build_index(df, ("body",), blocks=4)
    see = S.visibility(q, grants)
    assert {r.query_id: r._class for r in see.askers.collect()} == {1: "of ann", 4: "of ann", 7: "of ann", 2: "of bob", 5: "*", 6: "of dan"}
    pairs = S._pairs(ix, S.keyword_terms(q, ix, {"body": 1.0}), None, see)
    who = {n: u for n, _, u in questions}
    for r in pairs.select("query_id", "doc_id").distinct().collect():
        assert who[r.query_id] == "root" or r.doc_id in may[who[r.query_id]]
    got = S.keyword_search(q, ix, 6, {"body": 1.0}, see).collect()
    for n, text, u in questions:
        see_it = (lambda d: True) if u == "root" else (lambda d: d in may.get(u, ()))
        assert [r.section_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == n] == brute(data, text, 6, see_it)


@pytest.mark.parametrize("options", [{}, {"max_query_values": 0, "block_rows": 37, "block_queries": 2}])
def test_vectors_by_class_and_by_group(spark, options):
    rng = random.Random(12)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    s = [(f"s{i:03d}", i % 11, vec(), f"g{i % 4 if i % 2 else i}") for i in range(150)]
    q = [(i, vec(), u) for i, u in enumerate(["ann", "eve", "bob", "root", "zoe", "ann"])]
    grants = [("ann", "1"), ("ann", "2"), ("eve", "2"), ("eve", "1"), ("bob", "7"), ("root", "*")]
    may = {"ann": {1, 2}, "eve": {1, 2}, "bob": {7}, "root": set(range(11)), "zoe": set()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9)
    sd = spark.createDataFrame(s, "section_id string, doc_id long, vector array<double>, group string")
    qd = spark.createDataFrame(q, "query_id long, vector array<double>, user_id string")
    gd = spark.createDataFrame(grants, "user_id string, doc_id string")
    plain, grouped = [], []
    for n, v, u in q:
        near = sorted((-cos(v, w), i, g) for i, d, w, g in s if d in may[u])
        plain += [(n, i) for _, i, _ in near[:5]]
        first = {}
        for x, i, g in near:
            first.setdefault(g, i)
        grouped += [(n, i) for i in list(first.values())[:5]]
    assert rows(S.vector_search(qd, sd.drop("group"), 5, gd, **options).select("query_id", "section_id")) == sorted(plain)
    assert rows(S.vector_search(qd, sd, 5, gd, **options).select("query_id", "section_id")) == sorted(grouped)


def test_related_questions_behind_many_copies(spark):
    near, far = [1.0, 0.0, 0.1], [0.8, 0.6, 0.0]
    faqs = [(f"f{i:03d}", 1, " Same QUESTION" if i % 2 else "same question", near) for i in range(200)] + [
        ("g1", 2, "second", far), ("g2", 2, "third", [0.7, 0.7, 0.0]), ("g3", 2, "asked itself", [1.0, 0.0, 0.0]), ("g4", 2, "far", [0.0, 1.0, 0.0])]
    f = spark.createDataFrame([(*x, "") for x in faqs], "faq_id string, doc_id long, question string, question_embedding array<double>, answer string")
    q = spark.createDataFrame([(1, "Asked itself", [1.0, 0.0, 0.0])], "query_id long, question string, vector array<double>")
    assert [r[1:3] for r in rows(S.related_questions(q, f))] == [(1, "same question"), (2, "second"), (3, "third")]


def test_class_names_cannot_pass_for_administrators(spark):
    q = spark.createDataFrame([(1, "x", "*")], "query_id long, question string, user_id string")
    g = spark.createDataFrame([("*", "3")], "user_id string, doc_id string")
    assert rows(A.visibility(q, g).askers) == [(1, "of *", False)]


def test_cells_reach_their_recall(spark):
    rng = random.Random(21)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(25)]
    s = [(f"s{i:04d}", i % 5, [x + rng.gauss(0, 0.4) for x in base[0 if i % 3 == 0 else i % 25]]) for i in range(1500)]   # a third in one cell
    q = [(i, [x + rng.gauss(0, 0.4) for x in base[i]], "ann" if i % 2 else "root") for i in range(20)] + [(99, [], "root"), (98, base[0], None)]
    sd = spark.createDataFrame(s, "section_id string, doc_id long, vector array<double>")
    qd = spark.createDataFrame(q, "query_id long, vector array<double>, user_id string")
    gd = spark.createDataFrame([("ann", "1"), ("ann", "4"), ("root", "*")], "user_id string, doc_id string")
    for g in (None, gd):
        found = cells.approximate_search(qd, sd, 8, g, cells=24, sample=400, block_rows=150, block_queries=3)
        got = rows(cells.recall_of(found, S.vector_search(qd, sd, 8, g)))
        assert len(got) == (21 if g is None else 20) and sum(r[2] for r in got) >= 0.9 * sum(r[1] for r in got)
        if g is not None:
            assert {r.doc_id for r in found.filter("query_id % 2 = 1").collect()} <= {1, 4}
    whole = cells.approximate_search(qd, sd, 8, None, cells=1)                                        # one cell: exact
    assert rows(whole.select("query_id", "section_id", "rank")) == rows(S.vector_search(qd, sd, 8).select("query_id", "section_id", "rank"))
    assert cells.approximate_search(qd, sd.limit(0), 8).count() == 0


def test_index_is_stored_once_per_section(spark):
    """Postings are read from one row a section: planned without a shuffle or a sort, and so are sums per section."""
    df = spark.createDataFrame([(f"s{i}", i % 7, " ".join(f"running runs w{j}" for j in range(i % 5)), ["a b", f"k{i}"])
                                for i in range(60)], "section_id string, doc_id int, body string, keywords array<string>")
    for stem in (False, True):
        ix = S.build_index(df, ("body",), blocks=6, stem=stem)
        summed = ix.postings.groupBy("section_id").count()
        plan = summed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Sort " not in plan
        assert summed.count() == 60 and ix.postings.filter("field = 'keywords'").count() == 120
        known = {r.term: r.df for r in ix.terms.filter("field = 'body'").collect()}
        assert known["run"] == 48 if stem else known["runs"] == known["running"] == 48


def test_rare_stems_come_back_to_their_sections_without_a_shuffle_of_the_counts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lectern.plans import common

    texts = ["travel travels travelling", "claims claim filed", "filing files claims", "policies", "12 zz", ""]
    sections = spark.createDataFrame([(f"s{i}", f"d{i}", t) for i, t in enumerate(texts)], "section_id string, doc_id string, body string")
    few = S.build_index(sections, ("body",), blocks=3, stem=True)
    whole = S._stemmed
    monkeypatch.setattr(S, "COMMON_WORDS", 2)
    monkeypatch.setattr(S, "_stemmed", lambda table: whole(table, 0))
    many = S.build_index(sections, ("body",), blocks=3, stem=True)
    rows = lambda ix: sorted(tuple(r) for r in ix.postings.select("term", "section_id", F.round("impact", 9)).collect())
    assert rows(few) == rows(many) and ("travel", "s0") in [r[:2] for r in rows(many)] and len(rows(many)) == 8
    table = common.store_bucketed(spark.createDataFrame([("s", "d", 0, [("body", (1, [("claims", 1)]))])], (
        "section_id string, doc_id string, block int, counts array<struct<field:string,x:struct<len:int,tfs:array<"
        "struct<term:string,tf:int>>>>>")), "section_id", 3)
    plan = whole(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_words_of_the_texts_are_those_of_an_index(spark):
    from lectern.operators import sections as SE

    texts = ["Titel der Straße\r\nΟΔΥΣΣΕΥΣ ΣΑΣ\nΣ\n\n\n x \t y", "İstanbul ı I\nthe and not", "\t \n", "", None, "one line", "日本 12ab é b\n" * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ix = S.build_index(SE.line_sections(docs), ("section_title", "document_title", "body"), blocks=2)
    found = S.vocabulary(SE.line_texts(docs), "texts")
    want = rows(ix.terms.select("term").distinct())
    assert rows(found) == want and ("strasse",) in want and ("line",) in want and ("the",) not in want


def test_fuzzy_terms_builds_no_index(spark, tmp_path, monkeypatch):
    """the words come from one pass over the texts."""
    from lectern.suite import search_queries as Q

    texts = ["Travel claims\nare filed hier", "travels clams\nzz zy", None]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "travel claims zz liner")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0,)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(S, "build_index", lambda *a, **k: pytest.fail("an index is built"))
    assert rows(Q.search_fuzzy_terms(spark, str(tmp_path)).select("term", "match", "distance")) == [
        ("claims", "claims", 0), ("claims", "clams", 1), ("liner", "line", 1), ("travel", "travel", 0),
        ("travel", "travels", 1), ("zz", "zz", 0)]


def test_near_words_read_the_vocabulary_once_and_shuffle_no_keys_of_it(spark, tmp_path):
    words = ["a", "b", "ab", "ba", "abc", "abd", "travel", "travels", "", None]
    spark.createDataFrame([(w,) for w in words], "term string").write.parquet(f"{tmp_path}/v")
    asked = spark.createDataFrame([(w,) for w in words], "term string")
    near = spelling.near_words(asked, spark.read.parquet(f"{tmp_path}/v"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "SortMergeJoin" not in plan
    known = [w for w in words if w]
    want = [(a, b, edits(a, b)) for a in known for b in known if edits(a, b) <= (0 if len(a) <= 2 else 1 if len(a) <= 5 else 2)]
    assert rows(near) == sorted(want)
