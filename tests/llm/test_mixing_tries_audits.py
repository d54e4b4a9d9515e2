"""Curriculum mixing, conversation tries and filter audits against brute force and on edge cases."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import curriculum, filter_audit, turn_trie

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


# -- filter audit ------------------------------------------------------------------------------------------------------

def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    fails, out = [], []
    for d, text, part in docs:
        text = text or ""
        w = BLANK.findall(text)
        f = set()
        f |= {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        f |= {"D"} if set(text) & set("#$%&*|") else set()
        f |= {"E"} if d is not None and least[text] < d else set()
        fails.append((d, part or "", f))
    for part in {p for _, p, _ in fails}:
        mine = [(d, f) for d, p, f in fails if p == part]
        rows, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                alive = [(d, f) for d, f in mine if not f & before]
                gone = [d for d, f in alive if x in f]
                shapley[x] += len(gone)
                rows.append((part, "".join(order), step, len(alive) - len(gone), len(gone),
                             sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                             sum(d in good for d in gone), sum(d in toxic for d in gone), x))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    vocabulary = ["word%d" % i for i in range(300)]
    texts = [None, "", "AB CD", "a # b", "x\x0by\tz\x85w"] + [
        " ".join(rng.choice(vocabulary[:rng.choice([20, 300])]) for _ in range(rng.choice([5, 99, 100, 101, 140])))
        + rng.choice(["", " $", " " + "Q" * 90]) for _ in range(12)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, texts[4], "en"), (None, texts[4], "en"), (7, texts[6], "fr"), (7, texts[6], "fr"), (3, "", "fr")]
    docs += [(200 + i, "one text on a third of all rows", "en") for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 240, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*d, 1, "e") for d in docs], "doc_id long, text string, lang string, n long, mask string")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit_filters(df, la).collect())
    assert got == brute_audit(docs, labels)
    none = filter_audit.audit_filters(df, la.limit(0)).collect()
    assert {r.good_lost + r.toxic_lost for r in none} == {0} and len(none) == len(got)
    assert filter_audit.audit_filters(df.limit(0), la).count() == 0


def test_filter_audit_very_long_text_and_few_filters(spark):
    df = spark.createDataFrame([(1, "same " * 400_000, "en"), (2, "A" * 1_000_000, "en")], "doc_id long, text string, lang string")
    la = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit_filters(
        df, la, filters={"B": filter_audit.FILTERS["B"], "C": filter_audit.FILTERS["C"]}, copies=None).collect()}
    assert set(got) == {("BC", 1), ("BC", 2), ("CB", 1), ("CB", 2)}
    assert (got["BC", 1].removed, got["BC", 1].good_lost, got["BC", 2].removed, got["BC", 2].kept) == (1, 1, 1, 0)


@pytest.mark.parametrize("n", range(1, 7))
def test_adjacent_swaps_reach_every_order(n):
    order = list(range(n))
    seen = {tuple(order)}
    for k in filter_audit.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_diagram_is_shared_and_survives_swaps():
    masks = np.arange(32)
    counts = np.ones((32, 1), np.int64)                                   # all leaves alike: one node a level
    d = filter_audit.Diagram("ABCDE", masks, counts)
    for k in filter_audit.adjacent_swaps(5):
        d.swap(k)
        assert [len(x) for x in d.low] == [1] * 5 and d.weight[0].tolist() == [[32]]


# -- curriculum --------------------------------------------------------------------------------------------------------

def brute_targets(totals):
    """Stop sources at twice their size and reshare the excess by weight until none is above."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, stopped = 1.5 * sum(totals.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        share = {s: (want - sum(stopped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * totals[s]]
        if not over:
            return share | stopped
        stopped |= {s: 2 * totals[s] for s in over}


def mix_rows():
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 30, 300]))),
             rng.choice(["big"] * 6 + ["é", "a", "b", None, "", "Z"])) for i in range(400)]
    rows += [(None, "no id\x0bhere", "a"), (None, None, None), (5, "twice the same", "b"), (5, "twice the same", "b"), (6, "", "void")]
    return rows + [(9, "the very same row " * 20, "big")] * 150


def test_mix_sources(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size long, target string")
    got = curriculum.mix_sources(df).collect()
    totals = Counter()
    for _, text, s in rows:
        totals[s] += len(BLANK.findall(text or ""))
    want = brute_targets(totals)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, len(BLANK.findall(t or "")), s) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        taken[r.source] += r.taken
    assert {s: taken[s] for s in want} == {s: int(v + 0.5) for s, v in want.items()}
    where = [r.position for r in got if r.position is not None]
    assert where == sorted(where) and all(r.position is None for r in got[len(where):])
    again = curriculum.mix_sources(df.repartition(3)).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, got))
    assert curriculum.mix_sources(df.limit(0)).count() == 0
    assert {r.taken for r in curriculum.mix_sources(df.filter("text is null or text = ''")).collect()} == {0}


def test_positions_follow_the_schedules(spark):
    """At every time, each source has given the share of its target that its schedule has integrated."""
    rows = [(i, "w " * (5 + i % 7), "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = curriculum.mix_sources(df, keep=("text",))
    out = curriculum.training_order(mixed).collect()
    assert [r.position for r in out] == sorted(r.position for r in out) and out[0].text
    for k, s in enumerate("abc"):
        knots = curriculum.SCHEDULES[k]
        t = np.linspace(0, 1, 10001)
        w = np.interp(t, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        given, target = 0, sum(r.words for r in out if r.source == s)
        for r in out:
            if r.source == s:
                assert abs(np.interp(r.position, t, area / area[-1]) - given / target) < 1e-3
                given += r.words


def test_curriculum_rejects_bad_schedules(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        curriculum.mix_sources(df, schedules=(((0.0, 0.0), (1.0, 0.0)),))


# -- conversation trie -------------------------------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
        ends[made].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node],
                   saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
                  for node, m in members.items()) if members else []


def talk(seed, n, words):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


def plain(r):
    return tuple(r)


@pytest.mark.parametrize("shards", [1, 5, 40])
@pytest.mark.parametrize("words", [["a"], ["a", "b", "é日"], [None, "", "a"]])
def test_trie_in_any_number_of_shards(spark, shards, words):
    rows = talk(shards, 70, words)
    rows += [(1000 + c, t, "user", w) for c in range(60) for t, w in enumerate(["hot", "copy", "of", "one", "talk"])]   # copies
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string")
        got = sorted(map(plain, turn_trie.conversation_trie(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute_trie(rows), key=repr)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    long = [(2, t, "user", f"turn {t}") for t in range(1, 700)] + [(7, t, "user", f"turn {t}") for t in range(1, 655)]
    rows = [(0, None, None, None), (0, 1, "user", "a"), (5, 0, "user", "x" * 500_000), (None, 0, "user", "lost"), (13, 0, "u", "b"),
            (-4, 0, "user", "a"), (2 ** 62, 0, "user", "a"), (3, 0, "user", "same"), (3, 0, "user", "same")] + long
    got = sorted(map(plain, turn_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=repr)
    signed = [r for r in rows if r[0] is None or r[0] >= 0]
    plus = sorted(map(plain, turn_trie.conversation_trie(spark.createDataFrame(signed, schema)).collect()), key=repr)
    assert plus == sorted(brute_trie(signed), key=repr)
    assert max(r[1] for r in got) >= 690
    one = spark.createDataFrame([(1, 0, "user", "a")], schema)             # h > 1 and no conversation 0: turnless
    assert [tuple(r)[:6] for r in turn_trie.conversation_trie(one).collect()] == [tuple(r)[:6] for r in brute_trie([(1, 0, "user", "a")])]
    assert turn_trie.conversation_trie(one.limit(0)).count() == 0


def test_equal_turns_have_one_defined_order(spark):
    rows = [(10, 0, "user", w) for w in "abcdefgh"]
    schema = "conv_id long, turn long, role string, text string"
    a, b = (sorted(map(plain, turn_trie.conversation_trie(spark.createDataFrame(x, schema).repartition(3)).collect()), key=repr)
            for x in (rows, rows[::-1]))
    assert a == b
