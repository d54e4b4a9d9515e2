"""Secret scans: trigram postings per shard of texts answer Boolean queries derived from the rules' patterns."""
from __future__ import annotations

import hashlib
import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import LOWER, pieces

MOST_STRINGS = 64
MOST_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if `group` is `least` characters or longer."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    """The word with its ASCII letters in either case (an ignore-case flag would also take look-alikes)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", "(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live", "(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private", "-----BEGIN (?:RSA |DSA |EC |OPENSSH |)PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """A query a matching text must satisfy: one of the sets has all its (lower-case) trigrams in the text.

    None where the pattern has no mandatory trigrams.  Stretches of the pattern that stand for few strings are spelled
    out; a wider part ends a stretch, and every ended stretch adds its demand.
    """
    def both(a, b):
        if a is None or b is None:
            return a if b is None else b
        made = list({x | y for x in a for y in b})
        return made if len(made) <= MOST_STRINGS else a

    def demand(strings: set[str]):
        sets = {frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings}
        return None if frozenset() in sets or not sets else list(sets)

    def one(op, arg) -> tuple[set[str] | None, list | None]:
        """Strings that the node stands for, or else its demand."""
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}, None
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                chars = {chr(a).lower() for _, a in arg}
                return (chars, None) if len(chars) <= MOST_CLASS else (None, None)
            return None, None
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            return {""}, None
        if name == "SUBPATTERN":
            return sequence(arg[-1])
        if name == "BRANCH":
            got = [sequence(x) for x in arg[1]]
            if all(s is not None for s, _ in got):
                return set().union(*(s for s, _ in got)), None
            asked = [q if s is None else demand(s) for s, q in got]
            return None, None if None in asked else [x for q in asked for x in q]
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            strings, asked = sequence(body)
            if strings is not None and int(high) <= 3 and len(strings) ** int(high) <= MOST_STRINGS:
                return {"".join(p) for n in range(low, int(high) + 1) for p in product(strings, repeat=n)}, None
            return None, (asked if strings is None else demand(strings)) if low else None
        return None, None

    def sequence(nodes) -> tuple[set[str] | None, list | None]:
        run, asked, exact = {""}, None, True
        for op, arg in nodes:
            strings, more = one(op, arg)
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            asked, exact = both(asked, demand(run)), False
            run = strings if strings is not None else {""}
            asked = both(asked, more)
        return (run, None) if exact else (None, both(asked, demand(run)))

    strings, asked = sequence(parser.parse(pattern))
    return demand(strings) if strings is not None else asked


def postings(data: np.ndarray, offsets: np.ndarray, wanted: dict[str, int], table: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in which each wanted trigram stands."""
    if len(data) < 3:
        return {}
    low = LOWER[data].astype(np.uint32)
    which = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
    at = np.flatnonzero(which)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 2 < offsets[row + 1]
    pairs = np.unique(which[at[inside]].astype(np.int64) * (len(offsets) + 1) + row[inside])
    of, rows = np.divmod(pairs, len(offsets) + 1)
    return {t: rows[np.searchsorted(of, k):np.searchsorted(of, k, "right")] for t, k in wanted.items()}


def lookup(asked: list[frozenset[str]], posted: dict[str, np.ndarray]) -> np.ndarray:
    """Rows that satisfy a query: the rarest postings first, intersected, then united over the sets."""
    none, found = np.empty(0, np.int64), []
    for needs in asked:
        lists = sorted((posted.get(t, none) for t in needs), key=len)
        rows = lists[0]
        for more in lists[1:]:
            if not len(rows):
                break
            rows = rows[np.isin(rows, more, assume_unique=True)]
        found.append(rows)
    return np.unique(np.concatenate(found)) if found else none


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if re.fullmatch(r"\[[^]]*\]\+", r.pattern)
                                    else r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = {t: k + 1 for k, t in enumerate(sorted({t for q in self.queries for s in q or () for t in s
                                                              if all(ord(c) < 128 for c in t)}))}
        self.queries = [[frozenset(t for t in s if t in self.wanted) for s in q] if q else None for q in self.queries]
        self.queries = [None if q and frozenset() in q else q for q in self.queries]
        self.table = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 256 else np.uint16)
        for t, k in self.wanted.items():
            self.table[(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2])] = k

    def scan(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule number, end) in order of start, then rule."""
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        posted = postings(data, offsets, self.wanted, self.table)
        for k, (rule, asked) in enumerate(zip(self.rules, self.queries)):
            for row in range(len(texts)) if asked is None else lookup(asked, posted).tolist():
                for m in self.compiled[k].finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[row].append((m.start(), k, m.end()))
        for s in spans:
            s.sort()
        return spans


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scan_secrets(df: DataFrame, id: str = "doc_id", text: str = "text", more: tuple[Rule, ...] = MORE,
                 base: tuple[Rule, ...] = BASE, mask: str | None = None) -> DataFrame:
    """Per row: counts of the base rules, a digest of the base spans, all spans; with `mask` also the masked text.

    Each shard (a slice of rows) gets postings of the trigrams that the rules ask for; the rules' queries are answered
    on them, and only the rows found are matched.  A rule without mandatory trigrams (hex) is matched on every row.
    Nulls count as empty texts; every row gives one row, so repeated and null ids stay; other columns are not read.
    Spans are kind:start:end in code points, end exclusive.  Overlapping spans of different rules are all reported; a
    masked text has each maximal covered stretch replaced once, and a null text stays null.
    """
    rows = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rules, n_base = (*base, *more), len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules not in _scanners:
            _scanners[rules] = Scanner(rules)
        scanner = _scanners[rules]
        for piece, data, offsets in pieces(batches):
            texts = piece.column("text").to_pylist()
            found = scanner.scan([t or "" for t in texts], data, offsets)
            shown = [[f"{rules[k].kind}:{a}:{b}" for a, k, b in s] for s in found]
            own = [[x for x, (_, k, _) in zip(v, s) if k < n_base] for v, s in zip(shown, found)]
            cols = [piece.column("doc_id")]
            cols += [pa.array([sum(k == n for _, k, _ in s) for s in found], pa.int64()) for n in range(n_base)]
            cols += [pa.array([hashlib.sha256(",".join(v).encode()).hexdigest() for v in own], pa.string()),
                     pa.array([",".join(v) for v in shown], pa.string())]
            if mask is not None:
                cols.append(pa.array([masked(t, s, mask) for t, s in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans", *(["masked"] if mask is not None else [])]
    kinds = [kind, *["bigint"] * n_base, *["string"] * (len(names) - 1 - n_base)]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    if not text or not spans:
        return text
    out, at, covered = [], 0, -1
    for start, _, end in spans:
        if start > covered:
            out += [text[at:start], mask]
        covered = max(covered, end)
        at = covered
    return "".join(out) + text[at:]
