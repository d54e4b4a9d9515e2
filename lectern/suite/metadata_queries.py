"""Metadata, entities and governance."""
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import governance as G, metadata as M
from lectern.suite import inputs, query, sql, table

TYPES = {"report": ("and the",), "letter": ("de la", "para"), "manual": ("nicht", "und die"), "note": ("le les",)}
WORDS = ("the", "and", "thon", "nicht", "para", "avec")


def labelled(source, text, lexicon):
    """CTEs l0 (normalized, tokens) and l1 (labels) of a text column."""
    return (f"l0 AS (SELECT *, {sql.norm(text)} AS n, list_distinct({sql.tokens(text)}) AS toks FROM {source}), "
            f"l1 AS (SELECT *, {sql.labels('n', 'toks', lexicon)} AS labels FROM l0)")


@query("meta_document_types", f"""
WITH {inputs.TITLED}, x AS (SELECT doc_id, title || chr(10) || text AS x FROM titled), {labelled('x', 'x', TYPES)}
SELECT doc_id, coalesce(labels[1], 'document') AS document_type FROM l1""")
def meta_document_types(spark, sf):
    """D1."""
    return inputs.first_line_documents(spark, sf).select("doc_id", M.document_type(
        F.col("title"), F.col("text"), TYPES).alias("document_type"))


@query("meta_section_types", f"""
WITH {inputs.LINES}, x AS (SELECT section_id, section_title || chr(10) || body AS x FROM lines), {labelled('x', 'x', inputs.LEXICON)}
SELECT section_id, coalesce(labels[1], 'general') AS section_type FROM l1""")
def meta_section_types(spark, sf):
    """D2."""
    return inputs.lines(spark, sf).select("section_id", M.section_type(
        F.col("section_title"), F.col("body"), inputs.LEXICON).alias("section_type"))


@query("meta_audiences", f"""
WITH {inputs.TITLED}, x AS (SELECT doc_id, title || chr(10) || text AS x FROM titled), n AS (SELECT doc_id, {sql.norm('x')} AS n FROM x)
SELECT doc_id, array_to_string(list_filter({sql.arr(WORDS)}, lambda w: contains(n, w)), '|') AS audiences FROM n""")
def meta_audiences(spark, sf):
    """D5."""
    return inputs.first_line_documents(spark, sf).select("doc_id", F.array_join(M.audiences(
        F.col("title"), F.col("text"), WORDS), "|").alias("audiences"))


def ranked_tags(parts, source, name, limit):
    """Weighted terms in tag order, as a table (doc, tags): parts are (sql text, weight)."""
    exploded = " UNION ALL ".join(
        f"SELECT id, {n} AS part, {w}::DOUBLE AS w, unnest(ts) AS t, unnest(range(0, len(ts))) AS p FROM (SELECT id, {sql.with_pairs('k')} AS ts "
        f"FROM (SELECT id, {sql.kept(x)} AS k FROM {source}))" for n, (x, w) in enumerate(parts))
    return f"""{name}_e AS ({exploded}),
{name}_s AS (SELECT id, t, round(sum(w + CASE WHEN contains(t, '_') THEN 0.6::DOUBLE ELSE 0 END), 6) AS s, min(part * 1000000 + p) AS ord
  FROM {name}_e WHERE {sql.informative('t')} GROUP BY id, t),
{name}_o AS (SELECT id, list(t ORDER BY s DESC, contains(t, '_') DESC, length(t) DESC, ord) AS ts FROM {name}_s GROUP BY id),
{name} AS (SELECT id, list_reduce(ts, lambda acc, t: CASE WHEN len(acc) >= {limit} OR list_contains(acc, replace(t, '_', ' '))
  OR (NOT contains(t, '_') AND len(list_filter(acc, lambda a: list_contains(string_split(a, ' '), t))) > 0) THEN acc
  ELSE list_append(acc, replace(t, '_', ' ')) END, []::VARCHAR[]) AS tags FROM {name}_o)"""


_CANON = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql.norm('title')},
  {sql.q(fixed.VERSION)}, '', 'gi'), {sql.q(fixed.DATE)}, '', 'gi'), '\\bmajor version\\b', '', 'g'), '\\bfinal\\b', '', 'g'), '[_\\-]+', ' ', 'g')"""
DOC_TAGS = f"""{inputs.TITLED}, tagged_in AS (SELECT doc_id AS id, title, stem, text, {sql.collapse(_CANON)} AS canonical FROM titled),
{ranked_tags([('title', 4), ('canonical', 3), ('stem', 2)], 'tagged_in', 'tags_a', 6)},
{ranked_tags([('title', 3), ('text', 1)], 'tagged_in', 'tags_b', 6)},
tagged_x AS (SELECT id, title || chr(10) || text AS x FROM tagged_in), {labelled('tagged_x', 'x', inputs.LEXICON)},
doc_tags AS (SELECT t.id AS doc_id, CASE WHEN len(a.tags) > 0 THEN a.tags WHEN len(b.tags) > 0 THEN b.tags ELSE l.labels END AS tags
  FROM tagged_in t LEFT JOIN tags_a a USING (id) LEFT JOIN tags_b b USING (id) LEFT JOIN l1 l USING (id))"""


@query("meta_document_tags", f"WITH {DOC_TAGS} SELECT doc_id, array_to_string(tags, '|') AS tags FROM doc_tags")
def meta_document_tags(spark, sf):
    """D3, D4 for documents."""
    return inputs.first_line_documents(spark, sf).select("doc_id", F.array_join(M.document_tags(
        F.col("title"), F.col("source_path"), F.col("text"), inputs.LEXICON), "|").alias("tags"))


@query("meta_section_tags", f"""
WITH {inputs.LINES}, i AS (SELECT section_id AS id, section_title, document_title, body FROM lines),
{ranked_tags([('section_title', 4), ('document_title', 2)], 'i', 'a', 5)},
{ranked_tags([('section_title', 3), ('body', 1)], 'i', 'b', 5)},
x AS (SELECT id, document_title || chr(10) || section_title || chr(10) || body AS x FROM i), {labelled('x', 'x', inputs.LEXICON)}
SELECT id AS section_id, array_to_string(CASE WHEN len(a.tags) > 0 THEN a.tags WHEN len(b.tags) > 0 THEN b.tags ELSE l.labels END, '|') AS tags
FROM i LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN l1 l USING (id)""")
def meta_section_tags(spark, sf):
    """D3, D4 for sections."""
    return inputs.lines(spark, sf).select("section_id", F.array_join(M.section_tags(
        F.col("document_title"), F.col("section_title"), F.col("body"), inputs.LEXICON), "|").alias("tags"))


def top_keywords(source, parts_cte, name):
    """Keywords of rows (id, part, text): most frequent informative terms of three characters or more."""
    return f"""{name}_k AS (SELECT id, part, {sql.kept('x')} AS k FROM {parts_cte}),
{name}_t AS (SELECT id, unnest(ts) AS t, unnest(range(0, len(ts))) + part * 1000000 AS p FROM (SELECT id, part, {sql.with_pairs('k')} AS ts FROM {name}_k)),
{name}_c AS (SELECT id, t, count(*) AS n, min(p) AS p FROM {name}_t WHERE length(t) >= 3 AND {sql.informative('t')} GROUP BY id, t),
{name} AS (SELECT id, (list(t ORDER BY n DESC, p))[1:16] AS kws FROM {name}_c GROUP BY id)"""


@query("meta_keywords", f"""
WITH {inputs.TITLED}, p AS (SELECT doc_id AS id, 0 AS part, title AS x FROM titled UNION ALL SELECT doc_id, 1, stem FROM titled
  UNION ALL SELECT doc_id, 2, text FROM titled), {top_keywords('titled', 'p', 'kw')}
SELECT d.doc_id, coalesce(array_to_string(kws, '|'), '') AS keywords FROM documents d LEFT JOIN kw ON kw.id = d.doc_id""")
def meta_keywords(spark, sf):
    """D6."""
    d = inputs.first_line_documents(spark, sf)
    stem = F.translate(F.regexp_replace(F.regexp_extract("source_path", r"([^/]*)$", 1), r"\.[^.]*$", ""), "_", " ")
    return d.select("doc_id", F.array_join(M.keywords(F.array("title", stem, "text")), "|").alias("keywords"))


@query("meta_term_counts", f"""
WITH {inputs.TITLED}, k AS (SELECT doc_id, {sql.kept('title')} AS a, {sql.kept('text')} AS b FROM titled),
t AS (SELECT doc_id, unnest(list_concat({sql.with_pairs('a')}, {sql.with_pairs('b')})) AS t FROM k),
c AS (SELECT doc_id, t, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT doc_id, count(*) AS n_terms, sum(n)::BIGINT AS token_length, max(n) AS top_count FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(token_length, 0) AS token_length, top_count,
  array_to_string({sql.uniq(sql.with_pairs('a'))}, '|') AS title_terms FROM documents d JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)""")
def meta_term_counts(spark, sf):
    """D7, D8."""
    counts = M.token_counts(F.array("title", "text"))
    d = inputs.first_line_documents(spark, sf).withColumn("c", counts)
    return d.select("doc_id", F.size("c").alias("n_terms"), M.token_length(F.col("c")).alias("token_length"), F.array_max(
        F.map_values("c")).alias("top_count"), F.array_join(M.title_terms(F.col("title")), "|").alias("title_terms"))


@query("meta_full_documents")
def meta_full_documents(spark, sf):
    """D1, D3-D8, C11-C13 as one pass, the columns of a document record (each column has its own checked query)."""
    out = M.document_metadata(inputs.first_line_documents(spark, sf), types=TYPES, topics=inputs.LEXICON, audience_words=WORDS)
    return out.select("doc_id", "canonical_title", "document_type", "version", "effective_date", F.array_join(
        "metadata_tags", "|").alias("tags"), F.array_join("keywords", "|").alias("keywords"), "token_length")


@query("meta_full_sections")
def meta_full_sections(spark, sf):
    """D2-D4, D6-D8 as one pass over line sections (each column has its own checked query)."""
    out = M.section_metadata(inputs.lines(spark, sf), types=inputs.LEXICON, topics=inputs.LEXICON)
    return out.select("section_id", "section_type", F.array_join("metadata_tags", "|").alias("tags"), F.array_join(
        "title_terms", "|").alias("title_terms"), F.array_join("keywords", "|").alias("keywords"), F.to_json(
        "token_counts").alias("token_counts"), "token_length")


# --- entities: the first words of every line, as the JSON an extraction service returns ------------
_W1 = "regexp_extract(body, '[A-Za-z]{2,}')"
CATEGORIES = ("role", "benefit", "action")


def _entity_json(spark, sf):
    ln = inputs.lines(spark, sf)
    word = F.regexp_extract("body", "[A-Za-z]{2,}", 0)
    kind = F.element_at(F.array(F.lit("role"), F.lit("Benefit "), F.lit("mystery")), (F.col("order_index") % 3 + 1).cast("int"))
    item = F.struct(word.alias("name"), kind.alias("category"), F.concat(F.lit("Seen in line "), F.col("order_index")).alias("context"),
                    F.array(F.concat(word, F.lit("s")), F.lit(" "), F.lower("lang")).alias("synonyms"))
    per_doc = ln.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("order_index", item.alias("e")))).alias("x"))
    return per_doc.select("doc_id", F.concat(F.lit("Here: "), F.to_json(F.transform("x", lambda s: s["e"])), F.lit(" done")).alias("raw"))


ENTITIES = (f"{inputs.LINES}, entities AS (SELECT doc_id, order_index AS pos, {_W1} AS name, "
            "['role', 'benefit', 'other'][order_index % 3 + 1] AS category, 'Seen in line ' || order_index AS context, "
            f"[{_W1} || 's', lang] AS synonyms FROM lines), good AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, "
            "name, category, context, synonyms FROM entities WHERE name <> '')")


def entities(spark, sf):
    return M.parse_entities(_entity_json(spark, sf), "raw", CATEGORIES)


@query("meta_entities", f"WITH {ENTITIES} SELECT doc_id, pos, name, category, context, array_to_string(synonyms, '|') AS synonyms FROM good")
def meta_entities(spark, sf):
    """D9."""
    return entities(spark, sf).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("meta_entity_lookup", f"""
WITH {ENTITIES}, k AS (SELECT doc_id, pos, name, context, unnest(list_concat([name], synonyms)) AS key, unnest(range(0, 3)) AS syn FROM good),
r AS (SELECT lower(trim(key)) AS key, doc_id, name, context, row_number() OVER (PARTITION BY lower(trim(key)) ORDER BY doc_id, pos, syn) AS n FROM k)
SELECT key, doc_id, name, context FROM r WHERE n = 1""")
def meta_entity_lookup(spark, sf):
    """D10."""
    return M.entity_lookup(entities(spark, sf)).select("key", "doc_id", "name", "context")


@query("meta_entity_tags", f"""
WITH {ENTITIES}, j AS (SELECT l.section_id, g.pos, unnest(list_concat([g.name], g.synonyms)) AS t, unnest(range(0, 3)) AS s
  FROM lines l JOIN good g USING (doc_id) WHERE g.category = 'benefit' OR contains(lower(l.body), lower(g.name))
  OR contains(lower(l.body), lower(g.synonyms[1])) OR contains(lower(l.body), lower(g.synonyms[2]))),
f AS (SELECT section_id, lower(trim(t)) AS t, min(pos * 10 + s) AS ord FROM j GROUP BY 1, 2), a AS (SELECT section_id, string_agg(t, '|' ORDER BY ord) AS tags FROM f GROUP BY 1)
SELECT l.section_id, coalesce(a.tags, '') AS tags FROM lines l LEFT JOIN a USING (section_id)""")
def meta_entity_tags(spark, sf):
    """D11."""
    return M.section_entity_tags(inputs.lines(spark, sf), entities(spark, sf), ("benefit",)).select(
        "section_id", F.array_join("entity_tags", "|").alias("tags"))


@query("meta_entity_text", f"""
WITH {ENTITIES}, c AS (SELECT doc_id, category, upper(category[1:1]) || category[2:] || ': ' || string_agg(name || ' (' || context || '; also: '
  || array_to_string(synonyms, ', ') || ')', '; ' ORDER BY pos) AS line FROM good GROUP BY 1, 2)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY category)) AS entity_text FROM c GROUP BY 1""")
def meta_entity_text(spark, sf):
    """D12."""
    return M.entity_text(entities(spark, sf)).select("doc_id", F.md5("entity_text").alias("entity_text"))


@query("meta_entity_categories", f"""
WITH {ENTITIES} SELECT doc_id, category, count(*) AS n, string_agg(name, ', ' ORDER BY pos) AS names FROM good GROUP BY 1, 2""")
def meta_entity_categories(spark, sf):
    """D13."""
    return M.entities_by_category(entities(spark, sf))


# --- governance: files named after the words that the rules look for --------------------------
NAMES = ("cloud-server-hardening-policy-v1.3", "hr-onboarding-checklist", "asset-inventory-sop", "ir-playbook-incident",
         "secure-coding-guideline", "remote-working-plan", "quality-procedure", "anti-trust-framework", "misc-notes")
_NAME = f"({sql.arr(NAMES)})[page_id % {len(NAMES)} + 1] || '-' || page_id || '.html'"
_FILES = f"files AS (SELECT page_id AS doc_id, {_NAME} AS file_name, html AS text, html FROM pages)"


def _files(spark, sf):
    p = table(spark, sf, "pages")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("page_id") % len(NAMES) + 1).cast("int"))
    return p.select(F.col("page_id").alias("doc_id"), F.concat(name, F.lit("-"), "page_id", F.lit(".html")).alias("file_name"),
                    F.col("html").alias("text"), "html")


def rule_sql(x, rules, default):
    return "CASE " + " ".join(f"WHEN {sql.any_contains(x, phrases)} THEN {sql.q(label)}" for label, phrases in rules) + f" ELSE {sql.q(default)} END"


_REVIEW = "CASE doc_type " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in G.REVIEW_CYCLES.items()) + " ELSE 'Annual' END"
GOVERNED = (f"{_FILES}, governed AS (SELECT *, {_REVIEW} AS review_cycle FROM (SELECT *, {rule_sql('lower(file_name)', *G.GOVERNANCE['doc_type'])} AS doc_type, "
            f"{rule_sql('lower(file_name) || lower(text)', *G.GOVERNANCE['audience'])} AS audience, "
            f"{rule_sql('lower(file_name)', *G.GOVERNANCE['category'])} AS category, {rule_sql('lower(file_name)', *G.GOVERNANCE['owner'])} AS owner FROM files))")


@query("gov_attributes", f"WITH {GOVERNED} SELECT doc_id, doc_type, audience, category, owner, review_cycle FROM governed")
def gov_attributes(spark, sf):
    """D14, D15."""
    return G.governance(_files(spark, sf)).select("doc_id", "doc_type", "audience", "category", "owner", "review_cycle")


_FALL = {"onboarding": "01/Mar/2024", "asset": "01/Apr/2024"}
_STOP = sql.arr(G.NAME_STOPWORDS)
_KW = (f"array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(replace(file_name, '.html', '')), '[^a-z0-9 ]+', ' ', 'g'), '\\S+'), "
       f"lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w))[1:7], ', ')")
_DATED = ("coalesce(nullif(regexp_extract(text, 'Date[:]\\s*(\\d{1,2}[/]\\w{3}[/]\\d{4})', 1), ''), nullif(regexp_extract(text, 'Date[:]\\s*(\\d{1,2}[/-]\\d{1,2}[/-]\\d{4})', 1), ''), "
          "nullif(regexp_extract(text, '(\\d{1,2}[/]\\w{3}[/]\\d{4})', 1), ''), nullif(regexp_extract(text, '(\\d{4}-\\d{2}-\\d{2})', 1), ''))")
_DATE = f"coalesce({_DATED}, CASE WHEN contains(lower(file_name), 'onboarding') THEN '01/Mar/2024' WHEN contains(lower(file_name), 'asset') THEN '01/Apr/2024' END, '01/Jan/2024')"
_VERSION = ("'v' || coalesce(nullif(regexp_extract(text, '[Vv]ersion\\s+(\\d+[\\d.]*)', 1), ''), nullif(regexp_extract(file_name, '(?i)v[.\\s]*(\\d+[\\d.]+)', 1), ''), '1.0')")


@query("gov_names_and_dates", f"""
WITH {_FILES} SELECT doc_id, {_KW} AS keywords, {_DATE} AS dated, {_DATED} IS NULL AS inferred, {_VERSION} AS version,
  {rule_sql('lower(file_name || text)', G.CLASSIFICATION_RULES, 'INTERNAL USE ONLY')} AS classification FROM files""")
def gov_names_and_dates(spark, sf):
    """D16-D19."""
    n, t = F.col("file_name"), F.col("text")
    d = G.effective_date(n, t, _FALL)
    return _files(spark, sf).select("doc_id", G.filename_keywords(n).alias("keywords"), d["date"].alias("dated"), d["inferred"].alias(
        "inferred"), G.governance_version(n, t).alias("version"), G.classification(n, t).alias("classification"))


TERMS = ((r"\b(?:the|and)\b", "REF-EN"), (r"\b(?:nicht|und)\b", "REF-DE"), (r"\b(?:para|los)\b", "REF-ES"), (r"\b(?:avec|les)\b", "REF-FR"))
# word boundaries count letters of every script, which RE2's own boundary does not
_EDGE = "(?:^|$|[^\\pL\\pN_])"
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(e, {sql.q('(?i)' + p.replace(chr(92) + 'b', _EDGE))}) THEN {sql.q(r)}"
                            for p, r in TERMS) + " END"


@query("gov_regulation_tags", f"""
WITH {inputs.LINES}, e AS (SELECT doc_id, order_index AS pos, '<p>' || replace(replace(body, '<', ' '), '&', ' ') || '</p>' AS e FROM lines),
s AS (SELECT doc_id FROM lines GROUP BY doc_id)
SELECT doc_id, pos, {_FIRST} AS regulation FROM e JOIN s USING (doc_id) WHERE {_FIRST} IS NOT NULL""")
def gov_regulation_tags(spark, sf):
    """Every line as a paragraph, patterns of words that occur."""
    ln = inputs.lines(spark, sf)
    para = F.concat(F.lit("<p>"), F.translate("body", "<&", "  "), F.lit("</p>"))
    docs = ln.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", para.alias("p")))),
                                                             lambda s: s["p"]), "").alias("html"))
    return G.regulation_tags(docs, patterns=TERMS).select("doc_id", "pos", "regulation")


ROLES = (("the", "English reader", "reads English"), ("nicht", "German reader", "reads German"), ("para", "Spanish reader", "reads Spanish"),
         ("avec", "French reader", "reads French"), ("http", "Linker", "follows links"))
_ROLE_ROWS = " UNION ALL ".join(f"SELECT doc_id, {n} AS pos, {sql.q(r)} AS role, {sql.q(d)} AS duty FROM x WHERE contains(t, {sql.q(w)})"
                                for n, (w, r, d) in enumerate(ROLES))


@query("gov_role_mentions", f"""
WITH x AS (SELECT page_id AS doc_id, lower(regexp_replace(html, '<[^>]+>', '', 'g')) AS t FROM pages WHERE NOT regexp_matches(html, '(?i)roles?\\s*(?:and|&amp;)\\s*responsibilit')),
r AS ({_ROLE_ROWS}) SELECT * FROM r WHERE doc_id IN (SELECT doc_id FROM r GROUP BY doc_id HAVING count(*) >= 2)""")
def gov_role_mentions(spark, sf):
    """D21."""
    return G.role_mentions(_files(spark, sf), duties=ROLES)


@query("gov_related_documents", f"""
WITH {GOVERNED}, t AS (SELECT DISTINCT category, file_name FROM governed), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY file_name) AS n FROM t),
h AS (SELECT category, list(file_name ORDER BY file_name) AS l FROM r WHERE n <= 6 GROUP BY category)
SELECT doc_id, array_to_string(list_filter(l, lambda x: x <> file_name)[1:5], '|') AS related FROM governed JOIN h USING (category)""")
def gov_related_documents(spark, sf):
    """First five other titles of the category."""
    return G.related_documents(G.governance(_files(spark, sf)), title="file_name").select(
        "doc_id", F.array_join("related", "|").alias("related"))


RELATED = {"Cloud & Infrastructure": ("Cloud Server Hardening Policy", "Network Policy"), "Information Security": ("Misc Notes", "Access Policy")}


@query("gov_related_titles", f"""
WITH {GOVERNED} SELECT doc_id, array_to_string(list_filter(CASE category WHEN 'Cloud & Infrastructure' THEN ['Cloud Server Hardening Policy', 'Network Policy']
  WHEN 'Information Security' THEN ['Misc Notes', 'Access Policy'] ELSE []::VARCHAR[] END,
  lambda p: NOT contains(substr(lower(replace(replace(file_name, '.html', ''), '-', ' ')), 1, 20), substr(lower(p), 1, 20))), '|') AS related FROM governed""")
def gov_related_titles(spark, sf):
    """D22 with a fixed map."""
    return G.governance(_files(spark, sf)).select("doc_id", F.array_join(G.related_from_map(
        F.col("file_name"), F.col("category"), RELATED), "|").alias("related"))


@query("gov_superseded", """
WITH d AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN doc_id <> first_id THEN 'superseded' ELSE 'current' END AS status, CASE WHEN doc_id <> first_id THEN 'doc' || first_id END AS new_name
FROM documents JOIN d USING (text)""")
def gov_superseded(spark, sf):
    """Exact copies are superseded by their first document."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    firsts = d.groupBy("h").agg(F.min("doc_id").alias("f"))
    pairs = d.join(firsts, "h").filter(F.col("doc_id") != F.col("f")).select(
        F.concat(F.lit("doc"), "doc_id").alias("old_name"), F.concat(F.lit("doc"), "f").alias("new_name"))
    named = d.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("file_name"))
    return G.superseded(named, pairs).select("doc_id", "status", "new_name")


REPORT = (f"{GOVERNED}, noted AS (SELECT *, strlen(text) // 1024 AS kb FROM governed), report AS (SELECT file_name AS source, "
          f"'Improved — metadata banner added' AS action, doc_type, {_VERSION} AS version, {_DATE} AS date, owner, audience, category, {_KW} AS keywords, review_cycle, "
          f"coalesce(nullif(concat_ws('; ', CASE WHEN {_DATED} IS NULL THEN 'Effective date not found in body — assigned ' || {_DATE} END, "
          "CASE WHEN kb > 100 THEN 'Large document (' || kb || ' KB) — consider further splitting by section' END), ''), 'Clean') AS notes FROM noted)")


@query("gov_improvement_report", f"WITH {REPORT} SELECT * FROM report")
def gov_improvement_report(spark, sf):
    """D24."""
    return G.improvement_report(_files(spark, sf), fallbacks=_FALL)


@query("gov_markup_titles", r"""
WITH x AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<span style="color:#0070c0">' || regexp_extract(html, '<h1>(.*?)</h1>', 1) || '</span>' ELSE '' END || html AS html FROM pages),
y AS (SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<span[^>]*(?:font-size:2[0-9]pt|color:#0070c0)[^>]*>(.*?)</span>', 1), '<[^>]+>', '', 'g'), '&amp;', '&'), '&#xa0;', ' '), '&lt;', '<'), '&gt;', '>')) AS s,
  trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&amp;', '&'), '&#xa0;', ' '), '&lt;', '<'), '&gt;', '>')) AS t FROM x)
SELECT page_id, CASE WHEN length(s) > 6 THEN s WHEN length(t) > 3 THEN t ELSE 'Doc ' || page_id END AS title FROM y""")
def gov_markup_titles(spark, sf):
    """D25."""
    p = table(spark, sf, "pages")
    span = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<span style="color:#0070c0">'), F.regexp_extract(
        "html", "<h1>(.*?)</h1>", 1), F.lit("</span>"))).otherwise(F.lit(""))
    return p.select("page_id", G.markup_title(F.concat(span, "html"), F.concat(F.lit("doc-"), "page_id", F.lit(".html"))).alias("title"))
