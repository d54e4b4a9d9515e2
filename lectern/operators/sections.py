"""Documents to titled sections, chunks and excerpts.

Everything here is a narrow projection: a document's lines, units and sections stay arrays inside
its row until the final explode, so sectioning never shuffles, whatever the spread of sizes.  Only reductions
store their rounds.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions.hof import STRINGS, indices, let, pack, slices_from
from lectern.functions.text import (clean_whitespace, collapse, estimate_tokens, file_stem, fold_case, head,
                                    strip, strip_tags, truncate, words)
from lectern.plans.common import store

UNITS = "array<struct<tag:string,text:string>>"
SECTIONS = "array<struct<title:string,text:string>>"


# --- line tests --------------------------------------------------------------
def is_heading(line: Column) -> Column:
    """Numbered, all capitals, or a short mostly capitalised line without a sentence end."""
    def test(t):
        alpha = F.filter(words(t), lambda w: w.rlike("[A-Za-z]"))

        def capitalised(w):
            first = F.substring(w, 1, 1)
            return ((F.upper(first) == first) & (F.lower(first) != first)) | (F.upper(w) == w)
        title_like = let(alpha, lambda a: (F.size(a) > 0) & (
            F.size(F.filter(a, capitalised)) / F.size(a) >= 0.75))
        return (t != "") & (F.length(t) < 180) & (
            t.rlike(r"^(\d+(\.\d+)*[\)\.]?)\s+.+") | t.rlike(r"^[A-Z][A-Z0-9 /&\-,]{4,}$")
            | (~t.rlike(r"[.?!;]$") & (F.size(words(t)) <= 12) & title_like))
    return let(strip(line), test)


def is_bullet(line: Column) -> Column:
    """B4."""
    return line.rlike(r"^[-*•]\s+.+") | line.rlike(r"^\d+[\.\)]\s+.+")


def clean_lines(text: Column) -> Column:
    """Trimmed non-empty lines of the cleaned text."""
    return F.filter(F.transform(F.split(clean_whitespace(text), "\n"), strip), lambda x: x != "")


# --- lines to units -----------------------------------------------------------
def text_units(text: Column) -> Column:
    """Headings become h2, bullets li, runs of other lines one paragraph joined by blanks."""
    tagged = F.transform(clean_lines(text), lambda x: F.struct(
        F.when(is_heading(x), "h2").when(is_bullet(x), "li").otherwise("p").alias("tag"), x.alias("text")))

    def group(ls):
        starts = F.filter(indices(ls), lambda i: (i == 1) | (F.element_at(ls, i)["tag"] != "p")
                          | (F.element_at(ls, F.greatest(i - 1, F.lit(1)))["tag"] != "p"))
        return let(starts, lambda st: F.transform(slices_from(ls, st), lambda run: F.struct(
            F.element_at(run, 1)["tag"].alias("tag"),
            F.array_join(F.transform(run, lambda u: u["text"]), " ").alias("text"))))
    return let(tagged, group)


# --- units to sections --------------------------------------------------------
def derive_title(text: Column) -> Column:
    """First line, or the second cell of a piped first line, up to 150 characters."""
    def pick(line):
        cells = F.filter(F.transform(F.split(line, r" \| "), strip), lambda c: c != "")
        cell = F.when(line.contains(" | "), let(cells, lambda cs: F.coalesce(
            F.try_element_at(cs, F.lit(2)), F.try_element_at(cs, F.lit(1)))))
        return (F.when(line == "", "Introduction")
                .when(cell.isNotNull() & (F.length(cell) <= 150), cell)
                .when(F.length(line) <= 150, line).otherwise("Introduction"))
    return let(strip(F.element_at(F.split(text, "\n"), 1)), pick)


def group_units(units: Column) -> Column:
    """array<struct<title, text, is_table, seen>>; a heading opens a section, a table is its own.

    ``seen`` tells whether the document has any heading.  Linear in the units: starts are cut into runs that a heading
    opens, and a run hands its title to each of its sections.
    """
    def group(us):
        heading = lambda u: u["tag"].startswith("h")
        is_table = lambda u: u["tag"] == "table"
        starts = F.filter(indices(us), lambda i: (i == 1) | heading(F.element_at(us, i)) | is_table(
            F.element_at(us, i)) | is_table(F.element_at(us, F.greatest(i - 1, F.lit(1)))))

        def titles(st):
            opens = F.filter(indices(st), lambda j: (j == 1) | heading(F.element_at(us, F.element_at(st, j))))
            return let(opens, lambda op: F.flatten(F.transform(slices_from(st, op), lambda run: let(
                F.element_at(us, F.element_at(run, 1)), lambda u: F.array_repeat(F.when(heading(u), F.coalesce(
                    F.substring(u["text"], 1, 200), F.lit("Introduction"))).otherwise("Introduction"), F.size(run))))))

        def build(st, seen):
            def one(z):
                body = F.array_join(F.transform(F.filter(z["run"], lambda u: ~heading(u)), lambda u: u["text"]), "\n")
                return F.struct(z["title"].alias("title"), clean_whitespace(body).alias("text"),
                                is_table(F.element_at(z["run"], 1)).alias("is_table"), seen.alias("seen"))
            zipped = F.arrays_zip(slices_from(us, st).alias("run"), titles(st).alias("title"))
            return F.filter(F.transform(zipped, one), lambda s: s["text"] != "")
        return let(F.struct(F.exists(us, heading).alias("seen"), starts.alias("st")),
                   lambda v: build(v["st"], v["seen"]))
    return let(units, group)


def exempt_tables(secs: Column) -> Column:
    """Sections with ``is_table`` true wherever a table of the document has the same text.

    Sorted by text, so the cost is n log n; a document without tables is left as it is.
    """
    def spread(s):
        starts = F.filter(indices(s), lambda i: (i == 1) | (
            F.element_at(s, i)["text"] != F.element_at(s, F.greatest(i - 1, F.lit(1)))["text"]))
        marked = let(starts, lambda st: F.flatten(F.transform(slices_from(s, st), lambda run: let(
            F.exists(run, lambda x: x["is_table"]), lambda any_table: F.transform(run, lambda x: F.struct(
                x["at"].alias("at"), x["title"].alias("title"), x["text"].alias("text"),
                any_table.alias("is_table"), x["seen"].alias("seen")))))))
        return F.transform(F.sort_array(marked), lambda x: x.dropFields("at"))
    by_text = F.sort_array(F.transform(secs, lambda s, i: F.struct(
        s["text"].alias("text"), i.alias("at"), s["title"].alias("title"), s["is_table"].alias("is_table"),
        s["seen"].alias("seen"))))
    return F.when(F.exists(secs, lambda s: s["is_table"]), let(by_text, spread)).otherwise(secs)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def _pieces(text: Column) -> Column:
    """Sentences when there are two or more, else words."""
    return let(sentences(text), lambda s: F.when(F.size(s) > 1, s).otherwise(words(text)))


def split_block(text: Column, target: int = 1800) -> Column:
    """An oversized paragraph packed from sentences, or words, up to ``target`` characters."""
    return let(strip(text), lambda t: F.when(t == "", F.array().cast(STRINGS)).when(
        F.length(t) <= target, F.array(t)).otherwise(
        F.transform(pack(_pieces(t), F.length, target, 1), lambda g: strip(F.array_join(g, " ")))))


def chunk_title(text: Column, prefix: Column, part: Column) -> Column:
    """``prefix — hint`` from the first line, else ``prefix - Part N``."""
    first = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip),
                                                 lambda x: x != ""), F.lit(1)), F.lit(""))
    clipped = let(first, lambda h: F.rtrim(F.when(F.length(h) > 60, F.regexp_replace(
        F.substring(h, 1, 60), " [^ ]*$", "")).otherwise(h), F.lit(".,;:—")))
    return let(clipped, lambda h: F.when(
        (F.length(h) >= 10) & (fold_case(h) != fold_case(prefix)),
        F.concat(prefix, F.lit(" — "), h)
    ).otherwise(F.concat(prefix, F.lit(" - Part "), part.cast("string"))))


def split_large(text: Column, prefix: Column, target: int = 1800, min_chars: int = 300) -> Column:
    """Paragraphs packed to ``target``; a chunk closes only when it holds ``min_chars``."""
    paras = let(paragraphs(text), lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(p))
    parts = F.flatten(F.transform(paras, lambda p: split_block(p, target)))
    chunks = F.transform(pack(parts, F.length, target, 0, min_chars), lambda g: F.array_join(g, "\n\n"))
    return let(chunks, lambda cs: F.when(F.size(cs) == 1, F.transform(cs, lambda c: F.struct(
        prefix.alias("title"), c.alias("text")))).otherwise(F.transform(cs, lambda c, i: F.struct(
            chunk_title(c, prefix, i + 1).alias("title"), c.alias("text")))))


def group_sections(units: Column, max_chars: int = 3200, target: int = 1800, min_chars: int = 300) -> Column:
    """Units to the final array<struct<title, text>>."""
    def finish(secs):
        titled = F.transform(secs, lambda s: F.struct(
            F.when(~s["seen"] & (F.size(secs) > 1), derive_title(s["text"])).otherwise(s["title"]).alias("title"),
            s["text"].alias("text"), s["is_table"].alias("is_table")))
        # a lone section with a real title loses the table exemption
        lone = (F.size(secs) == 1) & (F.element_at(secs, 1)["title"] != "Introduction")
        return F.flatten(F.transform(titled, lambda s: F.when(
            (F.length(s["text"]) <= max_chars) | (s["is_table"] & ~lone),
            F.array(F.struct(s["title"].alias("title"), s["text"].alias("text")))
        ).otherwise(split_large(s["text"], s["title"], target, min_chars))))
    return let(let(group_units(units), exempt_tables), lambda secs: F.when(
        F.size(secs) == 0, F.array().cast(SECTIONS)).otherwise(finish(secs)))


def explode_sections(docs: DataFrame, doc_id: str = "doc_id", sections: str = "sections") -> DataFrame:
    """One row per section with a repeatable ``section_id`` and 0-based ``order_index``."""
    keep = [c for c in docs.columns if c != sections]
    out = docs.select(*keep, F.posexplode(sections).alias("order_index", "_s"))
    return out.select(
        *keep, F.concat(F.col(doc_id).cast("string"), F.lit("#"), F.col("order_index")).alias("section_id"),
        "order_index", F.col("_s.title").alias("section_title"), F.col("_s.text").alias("body"))


def sectionize_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **sizes) -> DataFrame:
    """Plain-text documents to section rows."""
    keep = [c for c in docs.columns if c != text]
    return explode_sections(
        docs.select(*keep, group_sections(text_units(F.col(text)), **sizes).alias("sections")), doc_id)


def line_sections(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One section per non-empty line; the document's first line is its title."""
    lines = docs.withColumn("_l", clean_lines(F.col(text))).withColumn(
        "document_title", F.coalesce(F.try_element_at("_l", F.lit(1)), F.lit("")))
    keep = [c for c in lines.columns if c not in ("_l", text)]
    out = lines.select(*keep, F.posexplode("_l").alias("order_index", "body"))
    return out.withColumn("section_id", F.concat(
        F.col(doc_id).cast("string"), F.lit("#"), F.col("order_index"))).withColumn(
        "section_title", F.concat(F.lit("Line "), F.col("order_index") + 1))


def line_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a document's `line_sections` as one string, one a line: the lines (the first is the document's title)
    and the sections' titles.  For passes that need their words and not the sections: a title is there once, not by line."""
    titles = F.transform("_l", lambda x, i: F.concat(F.lit("Line "), i + 1))
    return docs.withColumn("_l", clean_lines(F.col(text))).select(
        *[c for c in docs.columns if c != text], F.array_join(F.concat("_l", titles), "\n").alias("texts"))


# --- titles -------------------------------------------------------------------
def clean_title(c: Column) -> Column:
    return F.substring(collapse(c), 1, 200)


def _title_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)),
                                     lambda t: F.length(t) >= 3))


def title_overlap(candidate: Column, file_title: Column) -> Column:
    return let(F.struct(_title_tokens(candidate).alias("a"), _title_tokens(file_title).alias("b")),
               lambda v: F.when((F.size(v["a"]) == 0) | (F.size(v["b"]) == 0), F.lit(0.0)).otherwise(
                   F.size(F.array_intersect(v["a"], v["b"])) / F.size(v["b"])))


def is_bad_title(title: Column, file_title: Column) -> Column:
    return (title == "") | fold_case(title).isin(*fixed.BAD_TITLES) | (title_overlap(title, file_title) == 0)


def select_title(path: Column, candidate: Column, markup_title: Column) -> Column:
    """First heading or line, markup title or file name, by word overlap with the file name."""
    def choose(v):
        c, m, f = v["c"], v["m"], v["f"]
        bad_c, bad_m = is_bad_title(c, f), is_bad_title(m, f)
        return (F.when(~bad_c & (bad_m | (title_overlap(c, f) > title_overlap(m, f))), c)
                .when(~bad_m, m).when(~bad_c, c)
                .otherwise(F.coalesce(F.nullif(f, F.lit("")), F.nullif(m, F.lit("")), file_stem(path))))
    return let(F.struct(clean_title(F.coalesce(candidate, F.lit(""))).alias("c"),
                        clean_title(F.coalesce(markup_title, F.lit(""))).alias("m"),
                        clean_title(F.translate(file_stem(path), "_", " ")).alias("f")), choose)


def first_title_line(lines: Column) -> Column:
    """First of the first eight lines that is non-empty and not longer than 180 characters."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.slice(lines, 1, 8), clean_title), lambda t: (
        t != "") & (F.length(t) <= 180)), F.lit(1)), F.lit(""))


def text_title(text: Column, path: Column) -> Column:
    """First line when shorter than 150, else the file stem."""
    return let(F.coalesce(F.try_element_at(clean_lines(text), F.lit(1)), F.lit("")), lambda t: F.when(
        (t != "") & (F.length(t) < 150), t).otherwise(file_stem(path)))


# --- chunks, halves, reductions ------------------------------------------------
def full_text(sections: Column) -> Column:
    """Section texts joined by a blank line."""
    return F.array_join(F.transform(sections, lambda s: s["text"]), "\n\n")


def plan_chunks(text: Column, budget: int) -> Column:
    """Token-budget chunks; +12 per join of paragraphs, +4 per join of sentences or words."""
    def block(p):
        return F.when(estimate_tokens(p) <= budget, F.array(p)).otherwise(F.transform(
            pack(_pieces(p), estimate_tokens, budget, 4), lambda g: strip(F.array_join(g, " "))))
    paras = let(paragraphs(text), lambda p: F.when(F.size(p) == 0, F.filter(
        F.array(strip(text)), lambda x: x != "")).otherwise(p))
    chunks = pack(F.flatten(F.transform(paras, block)), estimate_tokens, budget, 12)
    return F.filter(F.transform(chunks, lambda g: strip(F.array_join(g, "\n\n"))), lambda c: c != "")


def split_half(text: Column) -> Column:
    """Two halves by tokens, cut between paragraphs, else sentences, else words."""
    def halve(parts, sep):
        def cut(p, sizes):
            total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)

            def taken(half):
                # once the half is reached the count stays; a full take falls back to the middle
                return F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("run")), lambda a, x: F.when(
                    (a["n"] > 0) & (a["run"] >= half), a).otherwise(F.struct(
                        (a["n"] + 1).alias("n"), (a["run"] + x).alias("run"))), lambda a: a["n"])
            at = let(let(F.greatest(F.lit(1), F.floor(total / 2).cast("int")), taken), lambda n: F.when(
                (n <= 0) | (n >= F.size(p)), F.greatest(F.lit(1), F.floor(F.size(p) / 2).cast("int"))).otherwise(n))
            return let(at, lambda n: F.filter(F.array(
                strip(F.array_join(F.slice(p, 1, n), sep)),
                strip(F.array_join(F.slice(p, n + 1, F.size(p)), sep))), lambda x: x != ""))
        return let(parts, lambda p: let(F.transform(p, lambda x: estimate_tokens(x)), lambda z: cut(p, z)))
    return let(strip(text), lambda t: F.when(t == "", F.array().cast(STRINGS))
               .when(F.size(paragraphs(t)) > 1, halve(paragraphs(t), "\n\n"))
               .when(F.size(sentences(t)) > 1, halve(sentences(t), " "))
               .when(F.size(words(t)) > 1, halve(words(t), " ")).otherwise(F.array(t)))


def format_partials(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.concat(
        F.lit("Partial summary "), (i + 1).cast("string"), F.lit(":\n"), p)), "\n\n")


def plan_reduction(df: DataFrame, parts: str, budget: int, floor: int = 250,
                   combine: Callable[[Column], Column] | None = None) -> DataFrame:
    """Reduce an array of partial summaries to one text in ``reduced``.

    Each round packs partials into batches (entry text with its prefix, +12 per join) of half the
    former budget, never under ``floor``, and combines each batch; a row is finished when one is left,
    all fit the budget, or nothing changes.  ``combine`` maps a text to a text (default: truncate
    to 4 characters per budget token).  Rounds go on until no row is active: an active row loses at least one partial
    a round, finished rows are set aside, and each round reads the stored rows of the one before.
    """
    clean = lambda arr: F.filter(F.transform(arr, strip), lambda x: x != "")
    entry = lambda p: estimate_tokens(F.concat(F.lit("Partial summary:\n"), p))
    effective = max(budget, floor)
    shorten = combine or (lambda t: truncate(t, 4 * max(budget, floor)))
    active, finished = df.withColumn("_w", clean(F.coalesce(F.col(parts), F.array().cast(STRINGS)))), None
    while True:
        batch_budget = max(floor, effective // 2)

        def reduce_once(w):
            batches = let(pack(w, entry, batch_budget, 12), lambda b: F.when(
                F.size(b) <= 1, F.transform(w, lambda x: F.array(x))).otherwise(b))
            return F.transform(batches, lambda b: F.when(F.size(b) == 1, F.element_at(b, 1)).otherwise(
                shorten(format_partials(b))))
        formatted = format_partials(F.col("_w"))
        turn = active.withColumn("_n", F.when(F.size("_w") > 1, reduce_once(F.col("_w")))).withColumn(
            "reduced", F.when(F.size("_w") == 0, F.lit("")).when(F.size("_w") == 1, F.element_at("_w", 1))
            .when(estimate_tokens(formatted) <= effective, shorten(formatted)).when(F.col("_n") == F.col("_w"), formatted))
        turn = store(turn.withColumn("_w", F.when(F.col("reduced").isNull(), clean(F.col("_n")))).drop("_n"))
        done = turn.filter("reduced is not null").drop("_w")
        finished = done if finished is None else finished.unionByName(done)
        active = turn.filter("reduced is null").drop("reduced")
        if active.isEmpty():
            return finished
        effective = batch_budget


# --- outlines, overviews, excerpts ---------------------------------------------
def toc(html: Column) -> Column:
    """array<struct<level, text, anchor>> of h2/h3 headings; empty below three headings."""
    def build(hits):
        rows = F.transform(hits, lambda h: F.struct(
            F.regexp_extract(h, r"(?i)<h([23])", 1).cast("int").alias("level"), strip_tags(h).alias("text")))
        return F.when(F.size(hits) < 3, F.array().cast("array<struct<level:int,text:string,anchor:string>>")
                      ).otherwise(F.transform(F.filter(rows, lambda r: F.length(r["text"]) >= 3), lambda r: F.struct(
                          r["level"].alias("level"), r["text"].alias("text"),
                          F.btrim(F.regexp_replace(F.lower(r["text"]), "[^a-z0-9]+", "-"),
                                  F.lit("-")).alias("anchor"))))
    return let(F.regexp_extract_all(html, F.lit(r"(?i)<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>"), F.lit(0)), build)


def overview(html: Column, heads: str = "purpose|scope|introduction|overview",
             chars: int | None = None) -> Column:
    """The paragraph after a purpose-like heading, of 41 characters or more (its first ``chars``); else null."""
    hit = F.regexp_extract(html, rf"(?is)(?:{heads})[^>]*</h[1-4]>\s*<p[^>]*>(.*?)</p>", 1)
    return let(head(strip_tags(hit), chars), lambda t: F.when(F.length(t) > 40, t))


def needs_explanation(text: Column, is_image: Column, min_chars: int = 250) -> Column:
    """B28."""
    return is_image | (F.length(text) < min_chars)


def excerpt(units: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text",
            per_unit: int = 300, total: int = 3000) -> DataFrame:
    """The head of each non-empty unit until ``total`` is reached, the crossing unit included."""
    head = units.select(doc, pos, F.substring(strip(F.col(text)), 1, per_unit).alias("_h")).filter(F.col("_h") != "")
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    kept = head.withColumn("_b", F.coalesce(F.sum(F.length("_h")).over(before), F.lit(0))).filter(
        F.col("_b") < total)
    return kept.groupBy(doc).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(pos, "_h"))), lambda s: s["_h"]), "\n\n").alias("excerpt"))


def excerpt_in_row(units: Column, per_unit: int = 300, total: int = 3000) -> Column:
    """B29 for units held as an array of strings: no shuffle."""
    heads = F.filter(F.transform(units, lambda u: F.substring(strip(u), 1, per_unit)), lambda h: h != "")
    zero = F.struct(F.array().cast(STRINGS).alias("parts"), F.lit(0).alias("n"))
    return F.aggregate(heads, zero, lambda a, h: F.when(a["n"] >= total, a).otherwise(F.struct(
        F.concat(a["parts"], F.array(h)).alias("parts"), (a["n"] + F.length(h)).alias("n"))),
        lambda a: F.array_join(a["parts"], "\n\n"))


def split_by_offsets(docs: DataFrame, splits: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Child documents from a splits table (doc, part, start_at, end_at or null); 0-based offsets."""
    start, end = F.col("start_at"), F.col("end_at")
    body = F.substring(F.col(text), start + 1, F.coalesce(end, F.length(text)) - start)
    return docs.join(splits, doc).withColumn("part_text", body).withColumn(
        "part_id", F.concat(F.col(doc).cast("string"), F.lit("#"), F.col("part"))).drop(text)
