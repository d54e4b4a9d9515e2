"""Labels by lexicon (C7): which labels of a phrase table a text carries."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.hof import STRINGS, let, lits, sql_array, sql_string
from lectern.functions.text import normalize_text

Lexicon = Mapping[str, Sequence[str]]


def phrase_tokens(phrase: str, stopwords: Sequence[str] = fixed.STOPWORDS) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", phrase.lower()) if t not in stopwords and len(t) >= 3]


def _literal(lexicon: Lexicon) -> Column:
    """The lexicon as one literal: array<struct<name, phrases, singles, multis>>."""
    rows = []
    for name, phrases in lexicon.items():
        parts = [phrase_tokens(p) for p in phrases]
        singles = sorted({p[0] for p in parts if len(p) == 1})
        multis = ", ".join(sql_array(sorted(set(p))) for p in parts if len(p) > 1)
        rows.append(f"named_struct('name', {sql_string(name)}, 'phrases', {sql_array(phrases)}, 'singles', "
                    f"{sql_array(singles)}, 'multis', cast(array({multis}) as array<array<string>>))")
    return F.expr(f"array({', '.join(rows)})")


def labels(text: Column, lexicon: Lexicon) -> Column:
    """Labels in lexicon order.

    A label matches when a phrase is a substring of the normalized text, or when the text holds
    the only significant word of a phrase, or two significant words of a longer one.  The lexicon
    is a literal of the plan, so no join and no shuffle is needed.
    """
    if not lexicon:
        return F.array().cast(STRINGS)

    def match(norm):
        tokens = F.array_distinct(F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)))
        return let(tokens, lambda toks: F.transform(F.filter(_literal(lexicon), lambda e: (
            F.exists(e["phrases"], lambda p: norm.contains(p)) | F.arrays_overlap(toks, e["singles"])
            | F.exists(e["multis"], lambda m: F.size(F.array_intersect(toks, m)) >= 2))), lambda e: e["name"]))
    return let(normalize_text(text), match)


def first_label(text: Column, lexicon: Lexicon, default: str) -> Column:
    return F.coalesce(F.try_element_at(labels(text, lexicon), F.lit(1)), F.lit(default))


def phrases_found(text: Column, phrases: Sequence[str]) -> Column:
    """Phrases that are substrings of the normalized text, in list order."""
    return let(normalize_text(text), lambda n: F.filter(lits(phrases), lambda p: n.contains(p)))


def flatten_map(keys: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Values of every key, in order, unique."""
    m = F.expr("map(" + ", ".join(f"{sql_string(k)}, {sql_array(v)}" for k, v in table.items()) + ")")
    return F.array_distinct(F.flatten(F.transform(
        keys, lambda k: F.coalesce(F.try_element_at(m, k), F.array().cast(STRINGS)))))
