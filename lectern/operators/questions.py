"""Question analysis: intents, terms, flags and texts derived from a table of questions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.hof import STRINGS, any_contains, any_startswith, let, lits, one_of
from lectern.functions.lexicon import Lexicon, flatten_map, labels
from lectern.functions.text import (fold_case, informative, is_digits, kept_tokens, keywordize,
                                    normalize_numbers, normalize_text, profile_is_empty, profile_line,
                                    profile_tags, strip, tokenize, uniq, words)


@dataclass(frozen=True)
class QuestionRules:
    """Word lists and phrase tables of the analysis; replace any of them for another vocabulary."""
    topics: Lexicon = field(default_factory=lambda: fixed.TOPICS)
    intents: Lexicon = field(default_factory=lambda: fixed.INTENTS)
    section_types: Mapping[str, Sequence[str]] = field(default_factory=lambda: fixed.INTENT_SECTION_TYPES)
    stopwords: Sequence[str] = fixed.STOPWORDS
    detail: Sequence[str] = fixed.DETAIL_PHRASES
    coverage: Sequence[str] = fixed.COVERAGE_PHRASES
    plural_nouns: Sequence[str] = fixed.PLURAL_NOUNS
    quantifiers: Sequence[str] = fixed.QUANTIFIERS
    references: Sequence[str] = fixed.REFERENCE_PHRASES
    reference_tokens: Sequence[str] = fixed.REFERENCE_TOKENS
    fillers: Sequence[str] = fixed.FILLER_TOKENS
    lookup_phrases: Sequence[str] = fixed.LOOKUP_PHRASES
    lookup_nouns: Sequence[str] = fixed.LOOKUP_NOUNS
    lookup_verbs: Sequence[str] = fixed.LOOKUP_VERBS
    precision: Sequence[str] = fixed.PRECISION_PHRASES
    assistant_name: str = ""


DEFAULT = QuestionRules()


def _has(arr: Column, values: Sequence[str]) -> Column:
    return F.arrays_overlap(arr, lits(list(values)))


def conversational_intent(text: Column, assistant_name: str = "") -> Column:
    """Greeting, farewell, thanks, identity, chitchat or self_referential; null for a real question."""
    identity = fixed.IDENTITY + ((f"what is {assistant_name.lower()}",) if assistant_name else ())

    def near(n, phrases):
        return F.exists(lits(phrases), lambda p: n.startswith(p) & (F.length(n) <= F.length(p) + 12))
    return let(normalize_text(text), lambda n: (
        F.when((n == "") | one_of(n, fixed.GREETINGS), "greeting").when(one_of(n, fixed.FAREWELLS), "farewell")
        .when(one_of(n, fixed.THANKS), "thanks").when(one_of(n, identity), "identity")
        .when(one_of(n, fixed.CHITCHAT), "chitchat").when(near(n, fixed.GREETINGS), "greeting")
        .when(near(n, fixed.FAREWELLS), "farewell").when(near(n, fixed.THANKS), "thanks")
        .when(any_contains(n, identity), "identity")
        .when(any_contains(n, fixed.SELF_REFERENCES), "self_referential")))


def phrase_terms(lexicon: Lexicon) -> list[str]:
    """Two-word terms of a lexicon's phrases, stop words left out."""
    out: list[str] = []
    for phrases in lexicon.values():
        for phrase in phrases:
            kept = [w for w in phrase.split() if w not in fixed.STOPWORDS and len(w) >= 2]
            out += [f"{a}_{b}" for a, b in zip(kept, kept[1:]) if f"{a}_{b}" not in out]
    return out


def focus_terms(text: Column, rules: QuestionRules = DEFAULT, limit: int = 20) -> Column:
    """Informative words, then qualifying word pairs; raw tokens when there are none."""
    known = lits(phrase_terms(rules.topics))

    def build(raw):
        # kept tokens hold no stop word, so a token carries meaning unless it is a number or generic
        plain = lambda t: ~is_digits(t) & ~one_of(t, fixed.GENERIC_TERMS)
        singles = F.filter(raw, plain)
        pairs = F.zip_with(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))), F.slice(raw, 2, F.size(raw)),
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        good = F.filter(F.when(F.size(raw) > 1, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>")),
                        lambda p: (plain(p["a"]) & (plain(p["b"]) | is_digits(p["b"])))
                        | F.array_contains(known, F.concat(p["a"], F.lit("_"), p["b"])))
        terms = F.concat(singles, F.transform(good, lambda p: F.concat(p["a"], F.lit("_"), p["b"])))
        fallback = F.filter(raw, lambda t: (F.length(t) >= 2) | (is_digits(t) & (t != "0")))
        return uniq(F.slice(let(terms, lambda x: F.when(F.size(x) > 0, x).otherwise(fallback)), 1, limit))
    return let(kept_tokens(text, rules.stopwords), build)


def is_document_lookup(text: Column, normalized: Column, rules: QuestionRules = DEFAULT) -> Column:
    """E4."""
    toks = F.filter(tokenize(text), lambda t: ~one_of(t, rules.stopwords))
    return F.coalesce(let(toks, lambda t: _has(t, rules.lookup_nouns) & (
        any_contains(normalized, rules.lookup_phrases) | one_of(F.try_element_at(t, F.lit(1)), rules.lookup_verbs)
        | ((F.size(t) <= 6) & one_of(F.try_element_at(t, F.lit(-1)), rules.lookup_nouns)))), F.lit(False))


def intents(text: Column, normalized: Column, rules: QuestionRules = DEFAULT) -> Column:
    """Lexicon labels with document_lookup first; ``general`` when there are none."""
    found = F.concat(F.when(is_document_lookup(text, normalized, rules), F.array(F.lit("document_lookup")))
                     .otherwise(F.array().cast(STRINGS)), labels(text, rules.intents))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("general"))))


def multi_doc(text: Column, normalized: Column, intent: Column, rules: QuestionRules = DEFAULT) -> Column:
    """E5."""
    toks = tokenize(text)
    return (F.array_contains(intent, "comparison") | any_contains(normalized, rules.coverage)
            | let(toks, lambda t: _has(t, rules.plural_nouns) & _has(t, rules.quantifiers)))


def exact_match(text: Column, normalized: Column, intent: Column, focus: Column, multi: Column,
                rules: QuestionRules = DEFAULT) -> Column:
    """E6."""
    n = F.size(F.filter(tokenize(text), lambda t: ~one_of(t, rules.stopwords)))
    digit = F.exists(focus, lambda t: F.exists(F.split(t, "_"), is_digits))
    pair = F.exists(focus, lambda t: t.contains("_"))
    return ~multi & ~_has(intent, ("document_lookup", "aggregate", "comparison")) & (
        any_contains(normalized, rules.precision) | digit | ((n <= 6) & pair)
        | ((n <= 4) & ~_has(intent, ("process", "checklist"))))


def context_dependent(text: Column, normalized: Column, focus: Column, rules: QuestionRules = DEFAULT) -> Column:
    """E7."""
    pair = F.exists(focus, lambda t: t.contains("_"))

    def test(raw):
        return let(F.filter(raw, lambda t: ~one_of(t, rules.stopwords)), lambda inf: (
            any_contains(normalized, rules.references) | (F.size(inf) == 0) | _has(raw, rules.reference_tokens)
            | ((F.size(inf) == 1) & ~pair & ~is_digits(F.coalesce(F.try_element_at(inf, F.lit(1)), F.lit(""))))
            | ((F.size(inf) <= 2) & ~pair & F.forall(inf, lambda t: one_of(t, rules.fillers) | is_digits(t)))))
    return let(tokenize(text), test)


def topic_expansion(topic: Column, rules: QuestionRules = DEFAULT) -> Column:
    """The topic itself and the keyword terms of all its phrases."""
    table: dict[str, list[str]] = {}
    for name, phrases in rules.topics.items():
        kept = [w for w in " ".join(phrases).split() if w not in fixed.STOPWORDS and (len(w) >= 2 or w.isdigit())]
        table[name] = [name.replace(" ", "_"), *kept, *[f"{a}_{b}" for a, b in zip(kept, kept[1:])]]
    return flatten_map(topic, table)


def analyze_questions(questions: DataFrame, text: str = "question", rules: QuestionRules = DEFAULT) -> DataFrame:
    """All columns that depend on the question alone, in one narrow pass."""
    q, n = F.col(text), F.col("normalized_question")
    out = (questions.withColumn("_num", normalize_numbers(q))
           .withColumn("normalized_question", normalize_text(F.col("_num")))
           .withColumn("focus_terms", focus_terms(F.col("_num"), rules))
           .withColumn("topic_hints", labels(q, rules.topics))
           .withColumn("intents", intents(q, n, rules)))
    out = (out.withColumn("context_dependent", context_dependent(q, n, F.col("focus_terms"), rules))
           .withColumn("multi_doc_expected", multi_doc(q, n, F.col("intents"), rules)))
    return (out.withColumn("exact_match_expected", exact_match(
                q, n, F.col("intents"), F.col("focus_terms"), F.col("multi_doc_expected"), rules))
            .withColumn("expanded_terms", uniq(F.concat("focus_terms", topic_expansion(F.col("topic_hints"), rules))))
            .withColumn("expected_section_types", flatten_map(F.col("intents"), rules.section_types))
            .withColumn("detail_requested", any_contains(n, rules.detail))
            .withColumn("low_confidence", low_confidence(F.col("intents"), F.col("topic_hints"), F.col("focus_terms")))
            .drop("_num"))


def low_confidence(intent: Column, topics: Column, focus: Column) -> Column:
    """Nothing but the general intent, no topic and at most two terms."""
    return (intent == F.array(F.lit("general"))) & (F.size(topics) == 0) & (F.size(focus) <= 2)


# --- expansions ----------------------------------------------------------------
def followup_expand(analysis: DataFrame, titles: str = "active_titles") -> DataFrame:
    """Context-dependent questions gain the informative terms of the active titles."""
    extra = F.flatten(F.transform(F.coalesce(titles, F.array().cast(STRINGS)),
                                  lambda t: uniq(informative(keywordize(t)))))
    return analysis.withColumn("expanded_terms", F.when(
        F.col("context_dependent"), uniq(F.concat("expanded_terms", extra))).otherwise(F.col("expanded_terms")))


def profile_expand(analysis: DataFrame, profile: str = "profile") -> DataFrame:
    """Profile tags that are not terms yet."""
    return analysis.withColumn("expanded_terms", F.concat("expanded_terms", F.array_except(
        profile_tags(F.col(profile)), F.col("expanded_terms"))))


def entity_expand(analysis: DataFrame, lookup: DataFrame, key: str = "query_id", text: str = "question",
                  stopwords: Sequence[str] = fixed.STOPWORDS) -> DataFrame:
    """Terms found in the entity lookup add synonyms and six context words, once per entity."""
    terms = analysis.select(key, F.posexplode(uniq(F.concat(tokenize(F.col(text)), "focus_terms"))).alias(
        "pos", "key"))
    context = F.slice(F.filter(tokenize(F.col("context")), lambda t: (F.length(t) >= 4) & ~t.isin(*stopwords)), 1, 6)
    hits = terms.join(lookup.select("key", F.lower("name").alias("entity"), F.concat(
        F.col("synonyms"), context).alias("adds")), "key")
    first = hits.groupBy(key, "entity").agg(F.min(F.struct("pos", "adds")).alias("f"))
    grouped = first.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("f")), lambda s: s["adds"]))
                                     .alias("entity_terms"))
    out = analysis.join(grouped, key, "left").withColumn(
        "entity_terms", F.coalesce("entity_terms", F.array().cast(STRINGS)))
    return out.withColumn("expanded_terms", uniq(F.concat("expanded_terms", "entity_terms")))


def merge_supplied(analysis: DataFrame, supplied: DataFrame, key: str = "query_id",
                   rules: QuestionRules = DEFAULT) -> DataFrame:
    """supplied(key, s_intents, s_terms, s_date, s_detail) merged into weak analyses."""
    valid = [*rules.section_types, "general"]
    none = F.array().cast(STRINGS)
    use = F.col("low_confidence") & F.col("s_intents").isNotNull()
    merged = let(uniq(F.concat(F.filter(F.coalesce("s_intents", none), lambda i: i.isin(*valid)), "intents")),
                 lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("general"))))
    out = analysis.join(supplied, key, "left")
    out = out.withColumn("intents", F.when(use, merged).otherwise(F.col("intents"))).withColumn(
        "focus_terms", F.when(use, uniq(F.concat("focus_terms", F.filter(F.coalesce("s_terms", none), lambda t: t != ""))))
        .otherwise(F.col("focus_terms")))
    return (out.withColumn("expected_section_types", flatten_map(F.col("intents"), rules.section_types))
            .withColumn("detail_requested", F.col("detail_requested") | (use & F.coalesce("s_detail", F.lit(False))))
            .withColumn("context_dependent", F.col("context_dependent") | (use & F.coalesce("s_date", F.lit(False))))
            .drop("s_intents", "s_terms", "s_date", "s_detail"))


# --- texts ---------------------------------------------------------------------
def _line(prefix: str, arr: Column, limit: int | None = None) -> Column:
    arr = F.coalesce(arr, F.array().cast(STRINGS))
    arr = F.slice(arr, 1, limit) if limit else arr
    return F.when(F.size(arr) > 0, F.concat(F.lit(prefix), F.array_join(arr, ", ")))


def canonical_question(text: Column, topics: Column, intent: Column, multi: Column, exact: Column,
                       context: Column, expanded: Column, titles: Column | None = None,
                       entities: Column | None = None, profile: Column | None = None) -> Column:
    """Labelled lines; at most 16 entity terms and 24 search terms."""
    lines = [F.concat(F.lit("User question: "), strip(text))]
    if profile is not None:
        lines.append(F.when(~profile_is_empty(profile), F.concat(F.lit("User context: "), profile_line(profile))))
    lines += [_line("Inferred policy topics: ", topics), _line("Inferred answer intent: ", intent),
              F.when(multi, "Expected evidence coverage: multiple documents"),
              F.when(exact, "Evidence preference: exact raw policy wording"),
              F.when(context, "Conversation context: active follow-up")]
    if titles is not None:
        lines.append(_line("Likely matching documents: ", titles))
    if entities is not None:
        lines.append(_line("Matched entity context: ", uniq(entities), 16))
    lines.append(_line("Expanded search terms: ", uniq(expanded), 24))
    return F.concat_ws("\n", *lines)


def retrieval_query(context: Column, summary: Column, topic: Column, titles: Column, topics: Column,
                    intent: Column, expanded: Column, canonical: Column) -> Column:
    """Thread context for follow-ups, then topics, intents, 24 terms and the canonical question."""
    ctx = lambda label, c: F.when(context & (F.coalesce(c, F.lit("")) != ""), F.concat(F.lit(label), c))
    return F.concat_ws("\n", ctx("Conversation summary: ", summary), ctx("Current topic: ", topic),
                       F.when(context, _line("Current documents: ", titles)),
                       _line("Inferred policy topics: ", topics), _line("Inferred user intent: ", intent),
                       _line("Expanded terms: ", expanded, 24), canonical)


def query_embedding_text(text: Column, intent: Column, context: Column) -> Column:
    """Short timeline follow-ups get date words appended."""
    return F.when((F.size(words(text)) <= 6) & F.array_contains(intent, "timeline") & context,
                  F.concat(text, F.lit(fixed.DATE_EXPANSION))).otherwise(text)


def split_compound(text: Column) -> Column:
    """Sub-questions: at question marks, else once at a joining question word, else the text."""
    def split(t):
        marks = F.filter(F.transform(F.split(t, r"\?"), strip), lambda p: p != "")
        at = F.regexp_instr(t, F.lit("(?i)" + fixed.COMPOUND))
        first = F.rtrim(strip(F.substring(t, F.lit(1), at - 1)), F.lit(",;"))
        second = strip(F.ltrim(F.ltrim(strip(F.substring(t, at, F.length(t))), F.lit("and ")), F.lit("also ")))
        return (F.when(F.size(marks) >= 2, F.transform(marks, lambda p: F.concat(p, F.lit("?"))))
                .when((at > 0) & (F.length(first) >= 12) & (F.length(second) >= 12),
                      F.array(F.concat(first, F.lit("?")), F.concat(second, F.lit("?"))))
                .otherwise(F.array(t)))
    return let(strip(text), split)


def sub_questions(questions: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    """E21 as rows (key, sub, sub_question)."""
    return questions.select(key, F.posexplode(split_compound(F.col(text))).alias("sub", "sub_question"))


# --- decision flags --------------------------------------------------------------
def needs_date(normalized: Column, intent: Column) -> Column:
    """E22."""
    return _has(intent, fixed.DATE_INTENTS) | any_contains(fold_case(normalized), fixed.DATE_MARKERS)


def needs_profile(normalized: Column, intent: Column, topics: Column, profile: Column | None = None) -> Column:
    """A personal question from somebody without a profile."""
    direct = any_startswith(normalized, fixed.PERSONAL_PREFIXES) | normalized.contains("for me")
    mine = normalized.rlike(r"\bmy\b") & (_has(intent, ("eligibility", "approval")) | (F.size(topics) == 0))
    return (direct | mine) & (profile_is_empty(profile) if profile is not None else F.lit(True))


def needs_clarification(normalized: Column, intent: Column, topics: Column, focus: Column, context: Column,
                        has_active: Column) -> Column:
    """The question is too vague to search with."""
    vague = any_contains(normalized, fixed.VAGUE_PHRASES)
    plain = F.forall(focus, lambda t: one_of(t, fixed.GENERIC_FOCUS_TERMS)) & (
        (F.size(focus) <= 2) | (F.size(words(normalized)) <= 6))
    return (context & ~has_active) | (~_has(intent, ("aggregate", "document_lookup")) & (F.size(topics) == 0)
                                      & (vague | plain))


def clarification_kind(normalized: Column, intent: Column, context: Column, has_active: Column) -> Column:
    """Which clarification to ask for."""
    return (F.when(context & ~has_active, "reference")
            .when(any_contains(normalized, fixed.VAGUE_PHRASES), "specific")
            .when(normalized.rlike(r"\b(?:i|me|my|mine)\b"), "personal")
            .when(F.array_contains(intent, "eligibility"), "eligibility")
            .when(_has(intent, ("approval", "process")), "process").otherwise("specific"))


def answer_style(normalized: Column, intent: Column, detail: Column, exact: Column, multi: Column) -> Column:
    """Style label by priority."""
    table = any_contains(normalized, fixed.TABLE_PHRASES)
    has = lambda *v: _has(intent, v)
    return (F.when(detail & ~table, "detail").when(table, "table").when(has("comparison"), "comparison")
            .when(exact, "exact").when(has("aggregate"), "aggregate").when(multi, "multi_doc")
            .when(has("document_lookup"), "lookup").when(has("approval"), "approval")
            .when(has("eligibility"), "eligibility").when(has("documents_required"), "documents")
            .when(has("checklist", "process"), "steps").when(has("timeline"), "timeline").otherwise("default"))


def role_ambiguous(questions: DataFrame, roles: Sequence[str] | None = None, text: str = "question",
                   intent: str = "intents") -> DataFrame:
    """Role-sensitive question that names no known role (a short list from the entity lookup)."""
    low = fold_case(F.col(text))
    sensitive = _has(F.col(intent), fixed.ROLE_INTENTS) | any_contains(low, fixed.ROLE_WORDS)
    return questions.withColumn("role_ambiguous", sensitive & ~any_contains(
        low, [r.lower() for r in (roles or fixed.DEFAULT_ROLES)]))
