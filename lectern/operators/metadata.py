"""Document and section metadata: types, tags, audiences, keywords, term counts, entities.

Per-document work stays inside the row; only entity tables join, on their document.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed, terms
from lectern.functions.hof import STRINGS, let
from lectern.functions.lexicon import Lexicon, first_label, phrases_found
from lectern.functions.text import (canonical_title, extract_date, extract_version, file_stem, head, keywordize,
                                    normalize_text, parsed_date, strip, uniq)


def _join(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def document_type(title: Column, text: Column, lexicon: Lexicon = fixed.DOCUMENT_TYPES,
                  chars: int | None = None) -> Column:
    """First label over the title and the text (its first ``chars`` characters), else ``document``."""
    return first_label(_join(title, head(text, chars)), lexicon, "document")


def section_type(title: Column, text: Column, lexicon: Lexicon = fixed.SECTION_TYPES,
                 chars: int | None = None) -> Column:
    """First label over the title and the text (its first ``chars`` characters), else ``general``."""
    return first_label(_join(title, head(text, chars)), lexicon, "general")


def audiences(title: Column, text: Column, words: Sequence[str] = fixed.AUDIENCES, chars: int | None = None) -> Column:
    """Audience words that are substrings of the title or the text (its first ``chars`` characters)."""
    return phrases_found(_join(title, head(text, chars)), words)


def document_tags(title: Column, path: Column, text: Column, topics: Lexicon = fixed.TOPICS,
                  chars: int | None = None) -> Column:
    """From title, canonical title and file stem; then title and text; then the topic lexicon.

    Informative terms are weighed by part, two-word terms +0.6 each time; order is weight, number
    of words, length, then first appearance.  A single word already inside a taken tag is passed over.
    """
    return terms.first_tags([title, canonical_title(title), F.translate(file_stem(path), "_", " "), head(text, chars)],
                            [{0: 4, 1: 3, 2: 2}, {0: 3, 3: 1}], 6, (0, 3), topics)


def section_tags(doc_title: Column, title: Column, text: Column, topics: Lexicon = fixed.TOPICS,
                 chars: int | None = None) -> Column:
    """D3, D4 for sections: section title and document title; then title and text; then topics."""
    return terms.first_tags([title, doc_title, head(text, chars)], [{0: 4, 1: 2}, {0: 3, 2: 1}], 5, (1, 0, 2), topics)


def keywords(parts: Column, limit: int = 16) -> Column:
    """Most frequent informative terms of three characters or more; ties by first appearance."""
    return terms.keywords(parts, limit)


def title_terms(title: Column) -> Column:
    """D7."""
    return uniq(keywordize(title))


def token_counts(pieces: Column) -> Column:
    """Map term -> count over the keyword terms of every piece."""
    return terms.counts(pieces)


def token_length(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)


def document_metadata(docs: DataFrame, title: str = "title", path: str = "source_path", text: str = "text",
                      types: Lexicon = fixed.DOCUMENT_TYPES, topics: Lexicon = fixed.TOPICS,
                      audience_words: Sequence[str] = fixed.AUDIENCES) -> DataFrame:
    """All document metadata columns (D1, D3-D8, C11-C13) in one narrow pass."""
    t, p, x = F.col(title), F.col(path), F.col(text)
    out = (docs.withColumn("normalized_title", normalize_text(t))
           .withColumn("canonical_title", canonical_title(t))
           .withColumn("document_type", document_type(t, x, types))
           .withColumn("version", extract_version(t, x))
           .withColumn("effective_date", extract_date(t, x))
           .withColumn("effective_day", parsed_date(F.col("effective_date")))
           .withColumn("metadata_tags", document_tags(t, p, x, topics))
           .withColumn("audiences", audiences(t, x, audience_words))
           .withColumn("title_terms", title_terms(t)))
    tags = F.concat(F.col("metadata_tags"), F.col("audiences"))
    pieces = F.concat(F.array(t, F.col("canonical_title")), tags, F.array(x))
    return (out.withColumn("keywords", keywords(F.concat(
                F.array(t, F.col("canonical_title"), F.translate(file_stem(p), "_", " ")), tags,
                F.array(x))))
            .withColumn("token_counts", token_counts(pieces))
            .withColumn("token_length", terms.total(pieces)))


def section_metadata(sections: DataFrame, doc_title: str = "document_title", title: str = "section_title",
                     text: str = "body", types: Lexicon = fixed.SECTION_TYPES,
                     topics: Lexicon = fixed.TOPICS) -> DataFrame:
    """All section metadata columns (D2-D4, D6-D8) in one narrow pass."""
    d, t, x = F.col(doc_title), F.col(title), F.col(text)
    out = (sections.withColumn("section_type", section_type(t, x, types))
           .withColumn("metadata_tags", section_tags(d, t, x, topics))
           .withColumn("title_terms", title_terms(t)))
    tags = F.col("metadata_tags")
    pieces = F.concat(F.array(t, d), tags, F.array(x))
    return (out.withColumn("keywords", keywords(F.concat(F.array(t), tags, F.array(x))))
            .withColumn("token_counts", token_counts(pieces))
            .withColumn("token_length", token_length(F.col("token_counts"))))


# --- entities ------------------------------------------------------------------
def entity_array(raw: Column, categories: Sequence[str]) -> Column:
    """array<struct<name, category, context, synonyms>> from a text that holds a JSON array.

    Items need a name and a context, an unknown category becomes ``other``; malformed text gives none.
    """
    found = F.regexp_extract(raw, r"(\[[\s\S]*\])", 1)
    items = F.coalesce(F.from_json(F.when(found != "", found), STRINGS), F.array().cast(STRINGS))

    def one(i):
        get = lambda k: strip(F.coalesce(F.get_json_object(i, "$." + k), F.lit("")))
        syns = F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(i, "$.synonyms"), STRINGS),
                                               F.array().cast(STRINGS)), strip), lambda s: s != "")
        return F.struct(get("name").alias("name"), let(F.lower(get("category")), lambda c: F.when(
            c.isin(*categories), c).otherwise("other")).alias("category"),
            get("context").alias("context"), syns.alias("synonyms"))
    return F.filter(F.transform(items, one), lambda e: (e["name"] != "") & (e["context"] != ""))


def parse_entities(docs: DataFrame, raw: str, categories: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """D9 as rows (doc, pos, name, category, context, synonyms)."""
    return docs.select(doc, F.posexplode(entity_array(F.col(raw), categories)).alias("pos", "_e")).select(
        doc, "pos", "_e.*")


def _entity_keys(name: Column, synonyms: Column) -> Column:
    return F.transform(F.concat(F.array(name), synonyms), lambda x: strip(F.lower(x)))


def entity_lookup(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Key -> entity; on conflict the first document, entity and synonym wins.

    ``min_by`` combines on the map side, so a key shared by a third of all entities stays cheap.
    """
    keyed = entities.select(doc, "pos", "name", "category", "context", "synonyms", F.posexplode(
        _entity_keys(F.col("name"), F.col("synonyms"))).alias("syn", "key")).filter(F.col("key") != "")
    return keyed.groupBy("key").agg(F.min_by(
        F.struct(F.col(doc).alias("doc_id"), "name", "category", "context", "synonyms"),
        F.struct(doc, "pos", "syn")).alias("e")).select("key", "e.*")


def entity_map(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Entities of a document as one ordered array (bounded by what one document names)."""
    return entities.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(
        "pos", "name", "category", "context", "synonyms"))).alias("entities"))


def section_entity_tags(sections: DataFrame, entities: DataFrame, global_categories: Sequence[str],
                        text: str = "body", doc: str = "doc_id") -> DataFrame:
    """Tags of the document's entities that are global or named in the section."""
    low = F.lower(F.col(text))
    used = F.filter("entities", lambda e: e["category"].isin(*global_categories) | low.contains(
        F.lower(e["name"])) | F.exists(e["synonyms"], lambda s: low.contains(F.lower(s))))
    tags = F.array_distinct(F.filter(F.flatten(F.transform(used, lambda e: _entity_keys(
        e["name"], e["synonyms"]))), lambda k: k != ""))
    return sections.join(entity_map(entities, doc), doc, "left").withColumn(
        "entity_tags", F.coalesce(tags, F.array().cast(STRINGS))).drop("entities")


def entity_text(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One line per category in name order, up to five synonyms an entity."""
    part = F.concat(F.col("name"), F.lit(" ("), F.col("context"), F.when(F.size("synonyms") > 0, F.concat(
        F.lit("; also: "), F.array_join(F.slice("synonyms", 1, 5), ", "))).otherwise(F.lit("")), F.lit(")"))
    lines = entities.groupBy(doc, "category").agg(F.concat(
        F.initcap(F.translate(F.first("category"), "_", " ")), F.lit(": "), F.array_join(F.transform(F.sort_array(
            F.collect_list(F.struct("pos", part.alias("t")))), lambda s: s["t"]), "; ")).alias("line"))
    return lines.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("category", "line"))), lambda s: s["line"]), "\n").alias("entity_text"))


def entities_by_category(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Entity names per document and category, in order."""
    return entities.groupBy(doc, "category").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))),
                                                         lambda s: s["name"]), ", ").alias("names"))
