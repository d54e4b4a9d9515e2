"""the English Snowball stemmer as expressions, for a table of distinct words.

Regions R1 and R2 are positions in the marked word; each step is a list of endings, the longest of which decides.  The
expressions use functions that Spark and other SQL engines share, one column a step, and every word is stemmed once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the published rules of the English Snowball stemmer -----------------
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1_HEADS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic",
    "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
          "ion", "al", "er", "ic")
VOWEL, OTHER, LI = "[aeiouy]", "[^aeiouy]", "[cdeghkmnrt]"


def _q(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ends(word: str, ending: str) -> str:
    return f"right({word}, {len(ending)}) = '{ending}'"


def _cut(word: str, n: int | str) -> str:
    """The word without its last n characters."""
    return f"substr({word}, 1, greatest(length({word}) - {n}, 0))"


def _has(word: str, pattern: str) -> str:
    return f"regexp_extract({word}, '{pattern}', 0) <> ''"


def _choose(cases: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {rest} END"


def _short(word: str) -> str:
    """Ends in a short syllable."""
    return f"({_has(word, f'{OTHER}{VOWEL}[^aeiouywxY]$')} OR {_has(word, f'^{VOWEL}{OTHER}$')})"


def _endings(table, start: str, more=None) -> str:
    """The longest ending of a step decides; it is replaced if it lies behind `start` (and `more` of that ending holds)."""
    cases = []
    for ending, put in sorted(table.items(), key=lambda e: -len(e[0])):
        where = [f"length(w) - {len(ending)} >= {start}", *((more or {}).get(ending, ()))]
        cases.append((_ends("w", ending), f"CASE WHEN {' AND '.join(where)} THEN {_cut('w', len(ending))} || '{put}' ELSE w END"))
    return _choose(cases, "w")


def steps() -> list[dict[str, str]]:
    """Columns of each step over those before it: `word` is the given word, `w` the word on its way."""
    marked = "CASE WHEN left(word, 1) = 'y' THEN 'Y' || substr(word, 2) ELSE word END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    region = f"^{OTHER}*{VOWEL}+{OTHER}"
    r1 = _choose([(f"left(w, {len(h)}) = '{h}'", str(len(h))) for h in R1_HEADS] + [
        (_has("w", region), f"length(regexp_extract(w, '{region}', 0))")], "length(w)")
    r2 = _choose([(_has("substr(w, r1 + 1)", region), f"r1 + length(regexp_extract(substr(w, r1 + 1), '{region}', 0))")],
                 "length(w)")
    plural = _choose([
        (_ends("w", "sses"), _cut("w", 2)),
        (f"{_ends('w', 'ied')} OR {_ends('w', 'ies')}", f"CASE WHEN length(w) > 4 THEN {_cut('w', 2)} ELSE {_cut('w', 1)} END"),
        (f"{_ends('w', 'us')} OR {_ends('w', 'ss')}", "w"),
        (f"{_ends('w', 's')} AND {_has('w', f'{VOWEL}.+s$')}", _cut("w", 1))], "w")
    kept = f"word IN ({_q(SPECIAL)}) OR length(word) <= 2 OR w IN ({_q(AFTER_PLURAL)})"
    gone = _choose([
        (f"{_ends('w', 'eedly')} OR {_ends('w', 'ingly')}", "5"), (f"{_ends('w', 'edly')}", "4"),
        (f"{_ends('w', 'eed')} OR {_ends('w', 'ing')}", "3"), (_ends("w", "ed"), "2")], "0")
    eed = f"({_ends('w', 'eedly')} OR {_ends('w', 'eed')})"
    past = _choose([
        ("gone = 0", "w"),
        (eed, f"CASE WHEN length(w) - gone >= r1 THEN {_cut('w', 'gone')} || 'ee' ELSE w END"),
        (_has(_cut("w", "gone"), VOWEL), _cut("w", "gone"))], "w")
    mended = _choose([
        (f"gone = 0 OR {eed} OR w = past", "past"),
        (f"right(past, 2) IN ('at', 'bl', 'iz')", "past || 'e'"),
        (f"right(past, 2) IN ({_q(DOUBLES)})", _cut("past", 1)),
        (f"length(past) <= r1 AND {_short('past')}", "past || 'e'")], "past")
    final_y = _choose([(f"length(w) > 2 AND {_has('w', f'{OTHER}[yY]$')}", f"{_cut('w', 1)} || 'i'")], "w")
    last = _choose([
        (f"{_ends('w', 'e')} AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {_short(_cut('w', 1))})", _cut("w", 1)),
        (f"{_ends('w', 'll')} AND length(w) - 1 >= r2", _cut("w", 1))], "w")
    special = _choose([(f"word = '{k}'", f"'{v}'") for k, v in SPECIAL.items()] + [
        ("length(word) <= 2", "word")], "lower(w)")
    hold = lambda e: {"w": f"CASE WHEN kept THEN w ELSE {e} END"}
    return [
        {"w": marked}, {"r1": r1}, {"r2": r2}, {"w": plural}, {"kept": kept}, {"gone": gone}, {"past": past}, hold(mended),
        hold(final_y),
        hold(_endings(STEP_2, "r1", {"ogi": (_ends("w", "logi"),), "li": (_has("w", f"{LI}li$"),)})),
        hold(_endings(STEP_3, "r1", {"ative": ("length(w) - 5 >= r2",)})),
        hold(_endings(dict.fromkeys(STEP_4, ""), "r2", {"ion": (_has("w", "[st]ion$"),)})),
        hold(last), {"stem": special}]


def stem_words(words: DataFrame, word: str = "term") -> DataFrame:
    """(word, stem) of the distinct words of a column: one narrow pass over the distinct words.

    Store it before joining: a filter on ``stem`` pushed below the steps would repeat them all.
    """
    df = words.select(F.col(word).alias("word")).distinct()
    for step in steps():
        df = df.withColumns({name: F.expr(value) for name, value in step.items()})
    return df.select("word", "stem")


def stem_sql(source: str, name: str) -> str:
    """The same as a chain of common table expressions over `source` (word); the last one is `name` (word, stem)."""
    out, before, columns = [], source, ["word"]
    for k, step in enumerate(steps()):
        made = f"{name}_{k}"
        keep = [c for c in columns if c not in step]
        out.append(f"{made} AS MATERIALIZED (SELECT {', '.join([*keep, *(f'{v} AS {c}' for c, v in step.items())])} FROM {before})")
        before, columns = made, [*keep, *step]
    return ", ".join(out) + f", {name} AS (SELECT word, stem FROM {before})"
