"""Each operator on edge cases and against brute force."""
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lectern.llm import codec, decontaminate, licenses, near_dups, personal, quality, repeats, secrets, url_graph, vector_dups

random.seed(4)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(400)]


def prose(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with copies, near copies in chains, and shared passages."""
    rows, base, shared = [], [prose(80) for _ in range(6)], prose(60)
    for i in range(90):
        w = list(random.choice(base)) if i % 3 else prose(random.randint(1, 90))
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            w[random.randrange(len(w))] = random.choice(VOCABULARY)
        if i % 7 == 0:
            w += shared
        rows.append((i, " ".join(w)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    made = [licenses.scan_licenses(docs), near_dups.near_documents(docs), codec.encode_decode(docs, model),
            decontaminate.contaminated(docs, items), personal.find_personal(docs), quality.score_quality(docs, labels),
            repeats.remove_repeats(docs), secrets.scan_secrets(docs),
            url_graph.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")),
            vector_dups.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<double>"))]
    assert [df.count() for df in made] == [0] * 10


def test_licenses(edges):
    got = {r.doc_id: r for r in licenses.scan_licenses(edges).collect()}
    assert len(licenses.scan_licenses(edges).collect()) == 8
    assert (got[7].base_labels, got[7].n_base, got[7].first_word, got[7].n_words) == ("mit", 1, 3, 9)
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
        if root == before:
            return sorted(((i, len(sets[i]), root[i], root[i] == i) for i in sets), key=repr)


def test_near_documents(spark, corpus, edges):
    rows, df = corpus
    assert rows_of(near_dups.near_documents(df), 4) == brute_near(rows)
    assert rows_of(near_dups.near_documents(df, block_rows=3), 4) == brute_near(rows)
    got = near_dups.near_documents(edges).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.doc_id == 5} == {1}
    assert {(r.n_shingles, r.kept) for r in got if r.doc_id in (2, 3)} == {(0, True)}


def test_sketch_follows_similarity():
    a = near_dups.mix(np.arange(1000, dtype=np.uint64))
    both = np.concatenate([a, near_dups.mix(np.arange(250, 1250, dtype=np.uint64))])
    s = near_dups.sketch(both, np.repeat([0, 1], 1000), 2, 4096)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.04
    assert (near_dups.sketch(a[:1], np.zeros(1, np.int64), 1) != np.uint64(2**64 - 1)).all()


def test_codec(spark, edges):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), codec.Codec(path)
    parts = list(" abAB▁\n\t0é日😀'\"#=") + ["the", " the", "    ", "<s>", "<0x41>", "aaa"]
    for text in ["", " ", *("".join(random.choice(parts) for _ in range(random.randint(1, 30))) for _ in range(500))]:
        assert own.encode(text) == library.encode(text)
        assert own.decode(own.encode(text)) == library.decode(library.encode(text))
    for r in codec.encode_decode(edges, path, ids=True).collect():
        text = dict((e[0], e[1]) for e in [(x.doc_id, x.text) for x in edges.collect()])[r.doc_id] or ""
        ids = library.encode(text)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, library.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_urls(spark):
    link = '<a href="http://good.org/x">g</a><a href="/own">o</a>'
    pages = [(1, "https://WWW.Example.com/en/1?x", None), (2, "http://a.example.com/en/", link), (3, "http://b.com/x#y", link),
             (4, "http://c.net/fr/1", '<a href="//bad.net/">'), (5, "http://bad.net/en/", '<a href="http://c.net/fr/">'),
             (6, None, None), (7, "no scheme", ""), (8, "http://good.org", ""), (8, "http://good.org", ""), (9, "x://com", "")]
    got = url_graph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert rows_of(got, 5) == sorted([
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "b.com", "/x", "com/", "allow"), (4, "c.net", "/fr/1", "net/fr/", "block"), (5, "bad.net", "/en/", None, "block"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "good.org", "", None, "allow"),
        (8, "good.org", "", None, "allow"), (9, "com", "", None, "allow")], key=repr)


def test_decontamination(spark, edges):
    items = [(k, " ".join(prose(30))) for k in range(12)]
    changed = items[3][1].split()
    changed[5], changed[9], changed[20] = "zzz", "yyy", "xxx"
    texts = [(k, " ".join(prose(150))) for k in range(60)]
    texts[7] = (7, " ".join(prose(40)) + " " + items[2][1] + " " + " ".join(prose(33)))
    texts[8] = (8, items[5][1])
    texts[9] = (9, " ".join(prose(41)) + " " + " ".join(changed) + " " + " ".join(prose(70)))
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"), rank=16)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(7, 2), (8, 5), (9, 3)}
    one = spark.createDataFrame([(1, "cat sat on the mat with password"), (2, None), (3, "...")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(edges, one, rank=4, more=2).collect()} == {1, 5}
    assert decontaminate.longest_common(list("abcbdab"), list("bdcaba")) == 4


def test_decontamination_finds_paraphrases_of_any_cosine(spark):
    rng = random.Random(11)
    common = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(300)]
    item = [rng.choice(common) for _ in range(36)] + ["rareone", "raretwo", "rarethree", "rarefour"]
    rng.shuffle(item)
    texts = [(k, " ".join(rng.choice(common) for _ in range(150))) for k in range(300)]
    expected = set()
    for k in range(40):
        told = list(item)
        rest = [i for i, w in enumerate(item) if not w.startswith("rare")]
        for i in rng.sample(rest, 8 if k < 20 else 15):
            told[i] = f"new{k}x{i}"
        expected.add((1000 + k, "verbatim" if k < 20 else "paraphrase"))
        texts.append((1000 + k, " ".join(rng.choice(common) for _ in range(60)) + " " + " ".join(told) + " " +
                      " ".join(rng.choice(common) for _ in range(50))))
    without = [w if not w.startswith("rare") else "gone" for w in item]
    without[[i for i, w in enumerate(item) if not w.startswith("rare")][0]] = "gone"
    texts += [(2000, " ".join(without)), (2001, " ".join(without[:18] + ["x"] * 9 + without[27:]))]
    expected.add((2000, "verbatim"))
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(
        [(1, " ".join(item))], "item_id long, text string"), rank=16)
    assert {(r.doc_id, r.kind) for r in got.collect()} == expected


def test_decontamination_space_is_fitted_on_every_row(spark):
    """Directions and variances of as few words as the space has dimensions are exact, over all of many rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6)]
    texts = [" ".join(rng.choices(vocabulary, [9, 5, 4, 3, 2, 1], k=70)) for _ in range(12_000)] + ["", None]
    space = decontaminate.fit_space(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), rank=6, more=2)
    word, _, _, _ = decontaminate.tokens(np.frombuffer(" ".join(vocabulary).encode(), np.uint8), np.array([0, 41]))
    f = decontaminate.features(word)
    assert len(set(f.tolist())) == 6
    df = np.array([sum(w in set(t.split()) for t in texts if t) for w in vocabulary])
    idf = np.log((len(texts) + 1) / (df + 1)) + 0.1
    assert np.allclose(space.idf[f], idf)
    rows = []
    for words in (t.split()[a:a + 64] for t in texts if t for a in (0, 64)):
        rows.append(idf * [words.count(w) for w in vocabulary])
        rows[-1] /= np.linalg.norm(rows[-1])
    inverse = np.linalg.inv(np.array(rows).T @ np.array(rows))
    got = space.vectors[f].astype(float)
    assert np.allclose(got @ got.T, idf[:, None] * inverse * idf, rtol=1e-3, atol=1e-9)


PERSONAL = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_personal(edges):
    parts = list("a@.-+%_ ()0123459\n é") + ["@a.b", "+1 (9", "255.", "4111 1111 1111 1111", "1.2.3.4"]
    for _ in range(2000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 50)))
        want = []
        for k, p in enumerate(PERSONAL):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                        or k == 2 and 14 <= len(digits) <= 19 and personal.luhn(digits) or k == 3 and 10 <= len(digits) <= 15):
                    want.append((m.start(), k, m.end()))
        assert sorted(personal.base_spans(text)) == sorted(want)
    got = personal.find_personal(edges).collect()
    assert len(got) == 8 and {(r.n_email, r.n_phone) for r in got if r.doc_id in (1, 7)} == {(1, 0), (0, 1)}
    sure = personal.fit({"phone:yyyy": 50, "local_phone:yy-y": 10, "local_phone:-n-n": 40})
    assert sure.probability("local_phone:yy-y") > 0.5 > sure.probability("local_phone:-n-n")


def test_quality(spark, edges):
    good = [(i, " ".join(prose(60)), 1) for i in range(200)]
    bad = [(i, " ".join([random.choice(VOCABULARY)] * 60), 0) for i in range(200, 260)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = quality.score_quality(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == (r.doc_id < 200) for r in held) and all(0 <= r.score <= 1 for r in got)
    few = quality.score_quality(edges, spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int"))
    assert few.count() == 8


def test_quality_threshold_covers_all_labelled_rows(spark):
    """The cut lies where the share of bad ones over all rows says, however few rows the weights are fitted on."""
    for n in (10, 1001):
        values = [(random.choice([random.random(), 0.5]), i % 3 == 0) for i in range(n)]
        at = quality.quantile_threshold(spark.createDataFrame(values, "strength double, good boolean"))
        ordered, bad = sorted(v for v, _ in values), sum(not g for _, g in values)
        assert at == (ordered[bad - 1] + min(v for v in ordered if v > ordered[bad - 1])) / 2
    assert quality.quantile_threshold(spark.createDataFrame([(0.3, True)], "strength double, good boolean")) == 0
    texts = [(i, " ".join(prose(60)) if i % 2 else " ".join([random.choice(VOCABULARY)] * 60), i % 2) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    for most in (30, 20_000):
        got = quality.score_quality(df.select("doc_id", "text"), df.select("doc_id", "quality"), most_rows=most).collect()
        learned = [r for r in got if not r.held_out]
        assert sum(r.predicted for r in learned) == sum(r.doc_id % 2 for r in learned)


@pytest.mark.parametrize("size, name", [(30, lambda i: i), (200, lambda i: i), (200, lambda i: None), (200, lambda i: i % 3 or None)],
                         ids=["short", "own", "null", "repeated"])
def test_repeats(spark, corpus, edges, size, name):
    if size < repeats.GRAM:
        size = 40
    rows, df = corpus
    rows = [(name(i), t) for i, t in rows + [(900, "x" * 500), (901, None), (902, "é" * 120), (0, "y" + rows[0][1]), (3, rows[3][1])]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for k in range(len(d) - size + 1):
            seen[d[k:k + size]] = seen.get(d[k:k + size], 0) + 1
    want = []
    for (i, _), d in zip(rows, data):
        gone = [False] * len(d)
        for k in range(len(d) - size + 1):
            if seen[d[k:k + size]] > 1:
                gone[k:k + size] = [True] * size
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for few in (4096, 2):
        assert rows_of(repeats.remove_repeats(df, length=size, shard_rows=few), 5) == sorted(want, key=repr)
    assert repeats.remove_repeats(edges).count() == 8


def test_suffix_array():
    for _ in range(200):
        t = [random.randint(1, 4) for _ in range(random.randint(1, 50))] + [0]
        assert repeats.suffix_array(np.array(t), 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_secrets(edges):
    rules = secrets.BASE + secrets.MORE
    scanner = secrets.Scanner(rules)
    parts = list(" =:'\"abcdef019_-") + ["password", "API_KEY", "token", "AKIA" + "A" * 16, "f" * 24, "ſecret", "eyJabcdefgh."]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 40))) for _ in range(800)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = [sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t)
                   if m.end(r.group) - m.start(r.group) >= r.least) for t in texts]
    assert scanner.scan(texts, data, offsets) == want
    got = secrets.scan_secrets(edges, mask="[S]").collect()
    assert len(got) == 8 and [r.masked[:32] for r in got if r.doc_id == 1] == ["The cat sat on the mat with [S] "]
    assert secrets.trigram_query("[0-9a-f]+") is None


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    rows = [(i, int(i % 3 == 0), (base[rng.integers(20)] + rng.standard_normal(16) * rng.choice([0, .1, .3])).tolist())
            for i in range(240)]
    x = np.array([v for _, _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([l for _, l, _ in rows])
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(240)
    for _ in range(240):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(240)])
    want = sorted(((i, int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(240)), key=repr)
    odd = [(900, 1, None), (901, 1, [0.0] * 16), (902, None, [1.0] * 16), (903, 1, [float("nan")] * 16), (None, 1, [1.0] * 16),
           (904, 1, []), (905, 1, [1.0, None])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    for cell in (2048, 16):
        got = rows_of(vector_dups.near_vectors(df, cell_rows=cell, partner_rows=32), 4)
        assert [r for r in got if r[0] is not None and r[0] < 900] == want
        assert all(r[1] == 0 and r[3] for r in got if r[0] is None or r[0] >= 900)
