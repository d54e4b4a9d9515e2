"""Snippets of DuckDB SQL shared by the expected results."""
from __future__ import annotations

from collections.abc import Sequence

from lectern.functions import fixed
from lectern.functions.lexicon import phrase_tokens


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"replace(lower({collapse(x)}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[a-z0-9]+')"


def digits(x: str) -> str:
    return f"regexp_full_match({x}, '[0-9]+')"


def kept(x: str, stop: Sequence[str] = fixed.STOPWORDS) -> str:
    return (f"list_filter({tokens(x)}, lambda t: (length(t) >= 2 OR {digits('t')}) "
            f"AND NOT list_contains({arr(stop)}, t))")


def pairs(k: str) -> str:
    """Neighbour pairs of a token list column."""
    return f"list_transform(range(1, len({k})), lambda i: {k}[i] || '_' || {k}[i + 1])"


def with_pairs(k: str) -> str:
    return f"list_concat({k}, {pairs(k)})"


def uniq(a: str) -> str:
    return f"list_transform([{a}], lambda l: list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i))[1]"


def informative(t: str) -> str:
    """For terms made of lower-case ASCII tokens joined by an underscore."""
    return (f"(CASE WHEN contains({t}, '_') THEN "
            f"len(list_filter(string_split({t}, '_'), lambda p: length(p) < 2 AND NOT {digits('p')})) = 0 "
            f"AND len(list_filter(string_split({t}, '_'), lambda p: NOT list_contains({arr(fixed.STOPWORDS)}, p) "
            f"AND NOT list_contains({arr(fixed.GENERIC_TERMS)}, p))) > 0 "
            f"ELSE length({t}) >= 2 AND NOT {digits(t)} AND NOT list_contains({arr(fixed.STOPWORDS)}, {t}) "
            f"AND NOT list_contains({arr(fixed.GENERIC_TERMS)}, {t}) END)")


def any_contains(x: str, phrases: Sequence[str]) -> str:
    return "(" + (" OR ".join(f"contains({x}, {q(p)})" for p in phrases) or "false") + ")"


def any_prefix(x: str, phrases: Sequence[str]) -> str:
    return "(" + (" OR ".join(f"starts_with({x}, {q(p)})" for p in phrases) or "false") + ")"


def has_any(a: str, values: Sequence[str]) -> str:
    return f"list_has_any({a}, {arr(values)})"


def labels(n: str, toks: str, lexicon) -> str:
    """Labels of a normalized text column and its token column."""
    cases = []
    for name, phrases in lexicon.items():
        tests = [f"contains({n}, {q(p)})" for p in phrases]
        for p in phrases:
            parts = phrase_tokens(p)
            if len(parts) == 1:
                tests.append(f"list_contains({toks}, {q(parts[0])})")
            elif parts:
                tests.append(f"len(list_intersect({toks}, {arr(sorted(set(parts)))})) >= 2")
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN {q(name)} END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def truncate(x: str, n: int) -> str:
    c = collapse(x)
    return f"(CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, {n - 3})) || '...' END)"


def joined(a: str, sep: str = "|") -> str:
    return f"array_to_string({a}, {q(sep)})"


def est_tokens(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN {s} = '' THEN 0 ELSE greatest(1, ceil(length({s}) / 4.0)::INT, "
            f"floor(len(regexp_extract_all({s}, '\\S+')) * 1.3::DOUBLE)::INT) END)")
