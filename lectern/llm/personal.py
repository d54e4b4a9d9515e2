"""Personal data: pattern spans, and weakly supervised spans whose labelers' reliabilities are estimated by EM."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pieces

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "social", "account", "handle")
KINDS = BASE + MORE

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOOSE = {
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "social": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "handle": re.compile(r"(?<![A-Za-z0-9@._%+-])@[A-Za-z_][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_.@-])"),
}
NEAR = 40
CONTEXT = {
    "email": re.compile(r"mail|contact|write|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobil|contact", re.I),
    "local_phone": re.compile(r"phone|call|tel|fax|mobil|contact", re.I),
    "social": re.compile(r"ssn|social|security|insurance", re.I),
    "account": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "handle": re.compile(r"twitter|follow|handle|user|insta|github", re.I),
}
#: Public suffixes, countries with bank account numbers and their lengths, common words after @.
SUFFIXES = frozenset("com org net edu gov io de fr es it uk us info biz eu ch at nl be ca au".split())
ACCOUNT_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "GB": 22, "CH": 21, "AT": 20, "NL": 18, "BE": 16}
NO_HANDLES = frozenset("media import param return override charset keyframes property todo".split())


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns: leftmost non-overlapping of each kind, failing matches dropped."""
    out = []
    if "@" in text:
        end = 0
        for at in iter_at(text):
            if at < end:
                continue
            m = _DOMAIN.match(text, at)
            if not m:
                continue
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                end = m.end()
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def iter_at(text: str) -> Iterator[int]:
    at = text.find("@")
    while at >= 0:
        yield at
        at = text.find("@", at + 1)


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the further kinds that touch no base span."""
    out, ends = [], sorted((a, b) for a, _, b in taken)
    any_digit = _DIGIT.search(text)
    for k, kind in enumerate(MORE, len(BASE)):
        if not ("@" in text if kind == "handle" else any_digit):
            continue
        for m in _LOOSE[kind].finditer(text):
            out.append((m.start(), k, m.end()))
    if not ends or not out:
        return out
    starts = np.array([a for a, _ in ends])
    reach = np.maximum.accumulate([b for _, b in ends])
    return [s for s in out if not ((i := int(np.searchsorted(starts, s[2])) - 1) >= 0 and reach[i] > s[0])]


def votes(text: str, span: tuple[int, int, int]) -> str:
    """The labelers on one candidate, a letter each (y, n, or - for no opinion): form, gazetteer, context, surroundings."""
    start, k, end = span
    kind, value = KINDS[k], text[start:end]
    digits = "".join(_DIGIT.findall(value))
    form = gazetteer = "-"
    if kind == "email":
        form = "y" if re.fullmatch(r"[^.].*[^.]@.*\.[A-Za-z]{2,}", value) else "n"
        gazetteer = "y" if value.rpartition(".")[2].lower() in SUFFIXES else "n"
    elif kind == "ip":
        form = "y" if not re.search(r"(^|\.)0[0-9]", value) else "n"
        gazetteer = "n" if digits in ("0000", "1234", "1000") else "-"
    elif kind == "card":
        form, gazetteer = "y", "y" if digits[0] in "3456" else "n"
    elif kind in ("phone", "local_phone"):
        form = "y" if re.search(r"[ ().-]", value) else "-"
        area = digits[-10:-7]
        gazetteer = "y" if area[:1] not in ("0", "1") and area[1:] != "11" else "n"
    elif kind == "social":
        form = "n" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "y"
    elif kind == "account":
        plain = value.replace(" ", "")
        rest = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        form = "y" if int(rest) % 97 == 1 else "n"
        gazetteer = "y" if ACCOUNT_LENGTH.get(plain[:2]) == len(plain) else "n" if plain[:2] in ACCOUNT_LENGTH else "-"
    elif kind == "handle":
        form = "y" if re.search("[0-9_]", value) else "-"
        gazetteer = "n" if value[1:].lower() in NO_HANDLES else "-"
    context = "y" if CONTEXT[kind].search(text, max(0, start - NEAR), start) else "-"
    beside = text[start - 1:start] + text[end:end + 1]
    around = "n" if re.search(r"[0-9A-Za-z=/#&]", beside) else "y" if re.fullmatch(r"[\s,;:()]*", beside) else "-"
    return form + gazetteer + context + around


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, by feature; the estimated class share and labeler reliabilities."""
    weights: dict[str, float]
    share: float
    reliability: dict[str, float]

    def probability(self, pattern: str) -> float:
        return 1 / (1 + np.exp(-sum(self.weights.get(f, 0.0) for f in features(pattern))))


def features(pattern: str) -> list[str]:
    """A pattern is kind, colon, votes: an intercept, the kind, and each vote."""
    kind, _, vote = pattern.partition(":")
    return ["one", kind, *(f"{i}{v}" for i, v in enumerate(vote))]


def fit(patterns: dict[str, int], rounds: int = 50) -> SpanModel:
    """EM over how often each vote pattern occurs, then a logistic classifier on the posteriors.

    The number of patterns is bounded by kinds and labelers (8 * 3^4), whatever the corpus; counts cover all of it.
    """
    keys, n = sorted(patterns), 4
    if not keys:
        return SpanModel({}, 0.5, {})
    count = np.array([patterns[k] for k in keys], float)
    vote = np.array([[{"y": 1, "n": 0, "-": -1}[v] for v in k.partition(":")[2]] for k in keys])
    yes = np.array([(v == 1).sum() >= (v == 0).sum() + 1 for v in vote]) * 0.8 + 0.1
    for _ in range(rounds):
        share = float(np.clip((count * yes).sum() / count.sum(), 0.02, 0.98))
        odds = np.full(len(keys), np.log(share / (1 - share)))
        right = []
        for j in range(n):
            said = vote[:, j] >= 0
            good = (count * np.where(vote[:, j] == 1, yes, 1 - yes))[said].sum() + 8
            right.append(float(np.clip(good / (count[said].sum() + 10), 0.55, 0.98)))
            odds += np.where(said, np.where(vote[:, j] == 1, 1, -1) * np.log(right[j] / (1 - right[j])), 0)
        yes = 1 / (1 + np.exp(-odds))
    names = sorted({f for k in keys for f in features(k)})
    x = np.array([[f in features(k) for f in names] for k in keys], float)
    w, weight = np.zeros(len(names)), count / count.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - yes)) + 1e-3 * w
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), grad)
    return SpanModel(dict(zip(names, w.tolist())), share,
                     dict(zip(("form", "gazetteer", "context", "around"), right)))


def find_personal(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: counts and a digest of the base spans, and all spans: base ones and candidates the classifier accepts.

    Vote patterns are counted over every row (pre-aggregated, a few thousand keys at most); EM and the classifier
    see only these counts.  Nulls count as empty texts; each row gives one row, repeated and null ids included; an
    empty table gives none; other columns are not read.  Spans are kind:start:end in code points, end exclusive;
    `found` says whether there are any.
    """
    rows = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for piece, _, _ in pieces(batches):
            for value in piece.column("text").to_pylist():
                value = value or ""
                base = base_spans(value)
                for s in base + loose_spans(value, base):
                    p = f"{KINDS[s[1]]}:{votes(value, s)}"
                    seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())],
                                         ["pattern", "n"])

    counted = rows.select("text").mapInArrow(patterns, "pattern string, n bigint").groupBy("pattern").agg(
        F.sum("n").alias("n")).collect()
    model = fit({r["pattern"]: r["n"] for r in counted})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def accepted(value: str, span: tuple[int, int, int]) -> bool:
            p = f"{KINDS[span[1]]}:{votes(value, span)}"
            if p not in known:
                known[p] = model.probability(p) >= threshold
            return known[p]

        for piece, _, _ in pieces(batches):
            counts, digests, shown = [[] for _ in BASE], [], []
            for value in piece.column("text").to_pylist():
                value = value or ""
                base = sorted(base_spans(value))
                spans = sorted(base + [s for s in loose_spans(value, base) if accepted(value, s)])
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(show(base).encode()).hexdigest())
                shown.append(show(spans))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(shown, pa.string())], names)

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE)
                           + ", base_sha256 string, spans string").withColumn("found", F.col("spans") != "")


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
