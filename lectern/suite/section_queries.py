"""Sectioning, markup, chunks and ingest tables."""
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sections as S
from lectern.plans.common import session_dir
from lectern.sources import files, messages, pages
from lectern.suite import inputs, query, sql, table

_UPPER = "upper(substr(w, 1, 1)) = substr(w, 1, 1) AND lower(substr(w, 1, 1)) <> substr(w, 1, 1)"


def heading(x: str) -> str:
    ws = f"regexp_extract_all({x}, '\\S+')"
    alpha = f"list_filter({ws}, lambda w: regexp_matches(w, '[A-Za-z]'))"
    return (f"({x} <> '' AND length({x}) < 180 AND (regexp_matches({x}, '^(\\d+(\\.\\d+)*[\\)\\.]?)\\s+.+') "
            f"OR regexp_matches({x}, '^[A-Z][A-Z0-9 /&\\-,]{{4,}}$') OR (NOT regexp_matches({x}, '[.?!;]$') AND len({ws}) <= 12 "
            f"AND len({alpha}) > 0 AND len(list_filter({alpha}, lambda w: ({_UPPER}) OR upper(w) = w)) / len({alpha}) >= 0.75)))")


def bullet(x: str) -> str:
    return f"(regexp_matches({x}, '^[-*•]\\s+.+') OR regexp_matches({x}, '^\\d+[\\.\\)]\\s+.+'))"


def greedy(arr: str, size: str, limit: int, cost: int, least: int = 0) -> str:
    """Greedy packing as a list fold: list of lists."""
    sz = size.replace("@", "x")
    proj = f"(acc.n + {sz} + CASE WHEN len(acc.cur) > 0 THEN {cost} ELSE 0 END)"
    close = f"len(acc.cur) > 0 AND {proj} > {limit} AND acc.n >= {least}"
    fold = (f"list_reduce({arr}, lambda acc, x: CASE WHEN {close} THEN {{'done': list_append(acc.done, acc.cur), 'cur': [x], "
            f"'n': ({sz})::BIGINT}} ELSE {{'done': acc.done, 'cur': list_append(acc.cur, x), 'n': {proj}::BIGINT}} END, "
            f"{{'done': []::VARCHAR[][], 'cur': []::VARCHAR[], 'n': 0::BIGINT}})")
    return (f"list_transform([{fold}], lambda f: CASE WHEN len(f.cur) > 0 THEN list_append(f.done, f.cur) ELSE f.done END)[1]")


def sentences(x: str) -> str:
    """Split after . ! ? followed by blanks, without look-behind."""
    mark = f"regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({mark}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def block(x: str, target: int) -> str:
    pieces = (f"CASE WHEN len({sentences(x)}) > 1 THEN {sentences(x)} ELSE regexp_extract_all({x}, '\\S+') END")
    packed = greedy(pieces, "length(@)", target, 1)
    return (f"CASE WHEN length({x}) <= {target} THEN [{x}] ELSE list_transform({packed}, "
            f"lambda g: trim(array_to_string(g, ' '))) END")


@query("section_line_kinds", f"""
WITH {inputs.LINES} SELECT lang, CASE WHEN {heading('body')} THEN 'heading' WHEN {bullet('body')} THEN 'bullet' ELSE 'plain' END AS kind,
  count(*) AS n, sum(length(body))::BIGINT AS n_chars FROM lines GROUP BY 1, 2""")
def section_line_kinds(spark, sf):
    """B3, B4 per language."""
    b = F.col("body")
    return inputs.lines(spark, sf).groupBy("lang", F.when(S.is_heading(b), "heading").when(S.is_bullet(b), "bullet").otherwise(
        "plain").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars"))


# lines -> units (runs of plain lines) -> sections (opened by headings)
UNITS = f"""{inputs.LINES}, tagged AS (SELECT doc_id, order_index AS i, body, CASE WHEN {heading('body')} THEN 'h2' WHEN {bullet('body')} THEN 'li'
  ELSE 'p' END AS tag FROM lines),
lagged AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY i) AS lt FROM tagged),
numbered AS (SELECT *, sum(CASE WHEN tag <> 'p' OR coalesce(lt, '') <> 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM lagged),
units AS (SELECT doc_id, u::BIGINT AS pos, min(tag) AS tag, string_agg(body, ' ' ORDER BY i) AS text FROM numbered GROUP BY doc_id, u)"""


@query("section_units", f"WITH {UNITS} SELECT doc_id, pos, tag, md5(text) AS text FROM units")
def section_units(spark, sf):
    """B1, B5."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(S.text_units(F.col("text"))).alias("p", "u")).select(
        "doc_id", (F.col("p") + 1).alias("pos"), "u.tag", F.md5("u.text").alias("text"))


_CHUNKS = greedy("parts", "length(@)", 1800, 0, 300)
_HINT = "rtrim(CASE WHEN length(c) > 60 THEN regexp_replace(substr(c, 1, 60), ' [^ ]*$', '') ELSE c END, '.,;:—')"
SECTIONS = f"""{UNITS}, opened AS (SELECT *, sum(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g,
  max(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS seen FROM units),
grouped AS (SELECT doc_id, g, coalesce(max(CASE WHEN tag = 'h2' THEN substr(text, 1, 200) END), 'Introduction') AS title, max(seen) AS seen,
  trim(string_agg(text, chr(10) ORDER BY pos) FILTER (tag <> 'h2')) AS text FROM opened GROUP BY doc_id, g),
filled AS (SELECT * FROM grouped WHERE coalesce(text, '') <> ''),
parted AS (SELECT doc_id, g, title, text, {block('text', 1800)} AS parts FROM filled),
chunked AS (SELECT doc_id, g, title, CASE WHEN length(text) <= 3200 THEN [text] ELSE list_transform({_CHUNKS},
  lambda x: array_to_string(x, chr(10) || chr(10))) END AS cs FROM parted),
pieces AS (SELECT doc_id, g, title, len(cs) AS n, unnest(range(1, len(cs) + 1)) AS j, unnest(cs) AS body FROM chunked),
hinted AS (SELECT *, string_split(body, chr(10))[1] AS c FROM pieces), hints AS (SELECT *, {_HINT} AS hint FROM hinted),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) - 1 AS order_index, body, CASE WHEN n = 1 THEN title
  WHEN length(hint) >= 10 AND lower(hint) <> lower(title) THEN title || ' — ' || hint ELSE title || ' - Part ' || j END AS section_title FROM hints)"""


@query("section_documents", f"""
WITH {SECTIONS} SELECT doc_id, order_index, doc_id || '#' || order_index AS section_id, section_title, md5(body) AS body FROM sections""")
def section_documents(spark, sf):
    """Every document to its final sections."""
    return S.sectionize_text(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "order_index", "section_id", "section_title", F.md5("body").alias("body"))


@query("section_blocks", f"""
WITH b AS (SELECT doc_id, {block("trim(text, ' ' || chr(10))", 600)} AS parts FROM documents)
SELECT doc_id, len(parts) AS n_parts, list_max(list_transform(parts, lambda p: length(p))) AS longest, md5({sql.joined('parts', '|')}) AS parts FROM b""")
def section_blocks(spark, sf):
    """B13 with a small target."""
    p = F.col("parts")
    return table(spark, sf, "documents").select("doc_id", S.split_block(F.col("text"), 600).alias("parts")).select(
        "doc_id", F.size(p).alias("n_parts"), F.array_max(F.transform(p, F.length)).alias("longest"),
        F.md5(F.array_join(p, "|")).alias("parts"))


@query("section_derived_titles", f"""
WITH {inputs.LINES}, f AS (SELECT section_id, body, list_filter(list_transform(string_split(body, ' | '), lambda c: trim(c)), lambda c: c <> '') AS cs FROM lines)
SELECT section_id, CASE WHEN contains(body, ' | ') AND length(coalesce(cs[2], cs[1])) <= 150 THEN coalesce(cs[2], cs[1])
  WHEN length(body) <= 150 THEN body ELSE 'Introduction' END AS title FROM f""")
def section_derived_titles(spark, sf):
    """B10 for every line as a section text."""
    return inputs.lines(spark, sf).select("section_id", S.derive_title(F.col("body")).alias("title"))


def _toks(x):
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 3))"


def _overlap(a, b):
    return (f"(CASE WHEN len({_toks(a)}) = 0 OR len({_toks(b)}) = 0 THEN 0 ELSE len(list_intersect({_toks(a)}, {_toks(b)})) / "
            f"len({_toks(b)}) END)")


def _bad(a):
    from lectern.functions import fixed
    return f"({a} = '' OR list_contains({sql.arr(fixed.BAD_TITLES)}, lower({a})) OR {_overlap(a, 'f')} = 0)"


_PATH = "'/data/' || regexp_replace(lower(coalesce(nullif(regexp_extract(c, '[a-zA-Z]{3,}'), ''), 'page')), '[^a-z]', '', 'g') || '_page_' || page_id || '.html'"


@query("section_titles", f"""
WITH p AS (SELECT page_id, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS c0, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS m0 FROM pages),
x AS (SELECT page_id, substr({sql.collapse('c0')}, 1, 200) AS c, substr({sql.collapse('m0')}, 1, 200) AS m FROM p),
y AS (SELECT *, regexp_replace(lower(coalesce(nullif(regexp_extract(c, '[a-zA-Z]{{3,}}'), ''), 'page')), '[^a-z]', '', 'g') || ' page ' || page_id AS f FROM x)
SELECT page_id, CASE WHEN NOT {_bad('c')} AND ({_bad('m')} OR {_overlap('c', 'f')} > {_overlap('m', 'f')}) THEN c
  WHEN NOT {_bad('m')} THEN m WHEN NOT {_bad('c')} THEN c ELSE f END AS title FROM y""")
def section_titles(spark, sf):
    """Heading, markup title or file name, whichever shares words with the file name."""
    c = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    word = F.coalesce(F.nullif(F.regexp_extract(c, "[a-zA-Z]{3,}", 0), F.lit("")), F.lit("page"))
    path = F.concat(F.lit("/data/"), F.lower(word), F.lit("_page_"), "page_id", F.lit(".html"))
    return table(spark, sf, "pages").select("page_id", S.select_title(path, c, F.regexp_extract(
        "html", "<title>(.*?)</title>", 1)).alias("title"))


@query("section_text_titles", f"""
WITH {inputs.LINES} SELECT doc_id, CASE WHEN length(document_title) < 150 THEN document_title ELSE lang || '_' || doc_id END AS title
FROM lines WHERE order_index = 0""")
def section_text_titles(spark, sf):
    """B16."""
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/in/"), "lang", F.lit("_"), "doc_id", F.lit(".txt"))
    return d.select("doc_id", S.text_title(F.col("text"), path).alias("title"))


def _unescape(x):
    for a, b in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, {sql.q(a)}, {sql.q(b)})"
    return x


_H = "html"
for _t in ("script", "style", "noscript", "svg"):
    _H = f"regexp_replace({_H if _H != 'html' else 'regexp_replace(html, ' + sql.q('(?s)<!--.*?-->') + ', ' + sql.q(' ') + ', ' + sql.q('g') + ')'}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', ' ', 'g')"
_H = f"regexp_replace({_H}, '(?i)<(?:meta|link|img|br|hr|input)\\b[^>]*?/?>', ' ', 'g')"
_H = f"regexp_replace({_H}, '(?i)<\\s*(?:br|/p|/div|/section|/article|/li|/tr|/td|/th|/h[1-6]|hr)\\b[^>]*>', chr(10), 'g')"
_H = _unescape(f"regexp_replace({_H}, '<[^>]+>', ' ', 'g')")
_PAGE_TEXT = (f"trim(regexp_replace(regexp_replace({_H}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))")


@query("section_page_text", f"SELECT page_id, length({_PAGE_TEXT}) AS n_chars, md5({_PAGE_TEXT}) AS text FROM pages")
def section_page_text(spark, sf):
    """B1, B2."""
    x = T.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", x.alias("x")).select("page_id", F.length("x").alias("n_chars"),
                                                                            F.md5("x").alias("text"))


# the pages hold h1, p and (inside nav only) li; an opening p ends an open one, as does the end of the article
_P = ("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>|</p>|<br>', chr(1), 'g'), '</h1>', '', 'g')")


@query("section_page_units", f"""
WITH a AS (SELECT page_id, string_split_regex({_P}, '<(p|h1)>') AS parts, regexp_extract_all({_P}, '<(p|h1)>', 1) AS tags FROM pages),
u AS (SELECT page_id, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(parts[2:]) AS raw FROM a),
c AS (SELECT page_id, i, tag, trim(array_to_string(list_filter(list_transform(string_split({_unescape('raw')}, chr(1)), lambda s: trim(s)), lambda s: s <> ''), ' ')) AS text FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY i) AS rn FROM c WHERE text <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, tag, md5(text) AS text FROM d WHERE rn = 1""")
def section_page_units(spark, sf):
    """Semantic units of real pages with unclosed tags."""
    return pages.page_units(table(spark, sf, "pages")).select("page_id", F.posexplode("page.primary").alias("pos", "u")).select(
        "page_id", "pos", "u.tag", F.md5("u.text").alias("text"))


_NODES = ("list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract({0}, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), "
          "'<[^>]*>', chr(1), 'g'), chr(1)), lambda s: trim({1})), lambda s: s <> '')").format("html", _unescape("s"))


@query("section_page_choice", f"""
WITH a AS (SELECT page_id, string_split_regex({_P}, '<(p|h1)>') AS parts, regexp_extract_all({_P}, '<(p|h1)>', 1) AS tags FROM pages),
u AS (SELECT page_id, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(parts[2:]) AS raw FROM a),
o AS (SELECT page_id, -1 AS i, 'div' AS tag, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS raw FROM pages
  UNION ALL SELECT page_id, 100000, 'div', regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|$)', 1) FROM pages UNION ALL SELECT * FROM u),
c AS (SELECT page_id, i, tag, trim(array_to_string(list_filter(list_transform(string_split({_unescape('raw')}, chr(1)), lambda s: trim(s)), lambda s: s <> ''), ' ')) AS text FROM o),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag = 'div', lower(text) ORDER BY i) AS rs, row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY i) AS rb
  FROM c WHERE text <> ''),
n AS (SELECT page_id, sum(CASE WHEN tag = 'p' AND rs = 1 THEN length(text) ELSE 0 END)::BIGINT AS p, sum(CASE WHEN tag <> 'h1' AND rb = 1 THEN length(text) ELSE 0 END)::BIGINT AS b,
  count(*) FILTER (tag <> 'div' AND rs = 1) AS n_units FROM d GROUP BY page_id),
z AS (SELECT page_id, length(array_to_string({_NODES}, chr(10))) AS z FROM pages)
SELECT page_id, p AS body_chars, (p = 0 OR (b > p + 300 AND b >= floor(p * 1.35::DOUBLE)) OR (b / z >= 0.45::DOUBLE AND b / z > p / z + 0.15::DOUBLE)) AS prefer_blocks, n_units
FROM n JOIN z USING (page_id)""")
def section_page_choice(spark, sf):
    """Body characters of the semantic units and whether block units would win."""
    p = F.col("page")
    return pages.page_units(table(spark, sf, "pages")).select(
        "page_id", pages.body_chars(p["primary"]).cast("bigint").alias("body_chars"),
        pages.should_prefer_blocks(p["primary"], p["blocks"], p["body"]).alias("prefer_blocks"),
        F.size(p["primary"]).alias("n_units"))


@query("section_pages")
def section_pages(spark, sf):
    """Pages to titled sections (no SQL: needs a markup tree; parts are checked by other queries)."""
    return pages.sectionize_pages(table(spark, sf, "pages")).select(
        "page_id", "order_index", "section_id", "document_title", "section_title", F.length("body").alias("n_chars"))


@query("section_tables", """
SELECT source, count(*) AS n_docs, min('S: ' || source || ' | ' || lang) AS first_cell FROM documents GROUP BY source""")
def section_tables(spark, sf):
    """A table built from documents, parsed back to piped rows."""
    d = table(spark, sf, "documents")
    html = F.concat(F.lit("<body><table><tr><th>S: "), "source", F.lit("</th><td></td><td>"), "lang",
                    F.lit("</td></tr></table></body>"))
    unit = F.element_at("page.primary", 1)["text"]
    return pages.page_units(d.select("source", html.alias("html"))).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.min(unit).alias("first_cell"))


@query("section_full_text", f"WITH {SECTIONS} SELECT doc_id, count(*) AS n_sections, md5(string_agg(body, chr(10) || chr(10) ORDER BY order_index)) AS full_text FROM sections GROUP BY doc_id")
def section_full_text(spark, sf):
    """B17."""
    s = S.group_sections(S.text_units(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).filter(F.size("s") > 0).select(
        "doc_id", F.size("s").cast("bigint").alias("n_sections"), F.md5(S.full_text(F.col("s"))).alias("full_text"))


_TOK = sql.est_tokens("@")
_TBLOCK = (f"CASE WHEN {sql.est_tokens('p')} <= 200 THEN [p] ELSE list_transform({greedy('CASE WHEN len(' + sentences('p') + ') > 1 THEN ' + sentences('p') + ' ELSE regexp_extract_all(p, ' + sql.q(chr(92) + 'S+') + ') END', _TOK, 200, 4)}, "
           "lambda g: trim(array_to_string(g, ' '))) END")


@query("section_token_chunks", f"""
WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS p FROM documents), b AS (SELECT doc_id, {_TBLOCK} AS parts FROM t),
c AS (SELECT doc_id, {greedy('parts', _TOK, 200, 12)} AS cs FROM b)
SELECT doc_id, len(cs) AS n_chunks, md5(array_to_string(list_transform(cs, lambda g: array_to_string(g, chr(10) || chr(10))), '|')) AS chunks FROM c""")
def section_token_chunks(spark, sf):
    """Chunks of at most 200 estimated tokens."""
    c = F.col("c")
    return table(spark, sf, "documents").select("doc_id", S.plan_chunks(F.col("text"), 200).alias("c")).select(
        "doc_id", F.size(c).alias("n_chunks"), F.md5(F.array_join(c, "|")).alias("chunks"))


@query("section_halves", f"""
WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents), s AS (SELECT doc_id, t, {sentences('t')} AS ss FROM t),
p AS (SELECT doc_id, t, CASE WHEN len(ss) > 1 THEN ss ELSE regexp_extract_all(t, '\\S+') END AS ps FROM s),
z AS (SELECT *, list_transform(ps, lambda x: {sql.est_tokens('x')}) AS sz FROM p),
n AS (SELECT *, list_reduce(sz, lambda a, x: CASE WHEN a.n > 0 AND a.run >= greatest(1, list_sum(sz) // 2) THEN a ELSE {{'n': a.n + 1, 'run': a.run + x}} END,
  {{'n': 0::BIGINT, 'run': 0::BIGINT}}).n AS k FROM z),
m AS (SELECT *, CASE WHEN k <= 0 OR k >= len(ps) THEN greatest(1, len(ps) // 2) ELSE k END AS c FROM n)
SELECT doc_id, md5(CASE WHEN len(ps) = 1 THEN t ELSE trim(array_to_string(ps[1:c], ' ')) END) AS left_half,
  md5(CASE WHEN len(ps) = 1 THEN '' ELSE trim(array_to_string(ps[c + 1:], ' ')) END) AS right_half FROM m""")
def section_halves(spark, sf):
    """B20."""
    h = F.col("h")
    return table(spark, sf, "documents").select("doc_id", S.split_half(F.col("text")).alias("h")).select(
        "doc_id", F.md5(F.element_at(h, 1)).alias("left_half"), F.md5(F.coalesce(F.try_element_at(h, F.lit(2)), F.lit(""))).alias(
            "right_half"))


@query("section_reductions")
def section_reductions(spark, sf):
    """Partial summaries of 60-token chunks, reduced to one text (iterative: no SQL)."""
    parts = F.transform(S.plan_chunks(F.col("text"), 60), lambda c: T.truncate(c, 120))
    d = table(spark, sf, "documents").select("doc_id", parts.alias("parts"))
    return S.plan_reduction(d, "parts", 400).select("doc_id", F.size("parts").alias("n_parts"), "reduced")


@query("section_summaries", f"""
WITH {inputs.LINES}, t AS (SELECT section_id, section_title, {sql.truncate('body', 320)} AS b, {sql.est_tokens('body')} * 100 AS tok FROM lines)
SELECT section_id, CASE WHEN starts_with(lower(b), lower(section_title)) THEN b ELSE section_title || ': ' || b END AS summary,
  (CASE WHEN tok <= 3000 THEN 1200 ELSE least(floor(1200::DOUBLE * least(tok / 3000.0::DOUBLE, 2.0::DOUBLE)), 2400) END)::INT AS budget FROM t""")
def section_summaries(spark, sf):
    """B22, B23."""
    return inputs.lines(spark, sf).select("section_id", T.fallback_summary(F.col("section_title"), F.col("body")).alias("summary"),
                                          T.summary_budget(T.estimate_tokens(F.col("body")) * 100).alias("budget"))


@query("section_content_kinds", """
SELECT source, CASE WHEN contains(lower(text), '<table') OR len(regexp_extract_all(text, '\\|')) >= 6 THEN 'table'
  WHEN regexp_matches(text, '\\n\\s{0,4}[-*•]\\s') THEN 'list' ELSE 'prose' END AS kind, count(*) AS n,
  count(*) FILTER (length(text) < 250) AS sparse FROM documents GROUP BY 1, 2""")
def section_content_kinds(spark, sf):
    """B25, B28."""
    t = F.col("text")
    return table(spark, sf, "documents").groupBy("source", T.content_kind(t).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(S.needs_explanation(t, F.lit(False))).alias("sparse"))


_HTML = ("'<h2>Purpose</h2><p>' || text || '</p>' || '<h3>' || lang || ' &amp; ' || source || '</h3><h2>Part ' || doc_id || '!</h2>'")


@query("section_contents", f"""
WITH h AS (SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest([2, 3, 2]) AS level, unnest(['Purpose', lang || ' & ' || source, 'Part ' || doc_id || '!']) AS text FROM documents)
SELECT doc_id, pos, level, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS anchor FROM h""")
def section_contents(spark, sf):
    """B26 over documents with headings added."""
    return _marked(spark, sf).select("doc_id", F.posexplode(S.toc(F.col("html"))).alias("pos", "t")).select("doc_id", "pos", "t.*")


def _marked(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "text", F.concat(
        F.lit("<h2>Purpose</h2><p>"), "text", F.lit("</p><h3>"), "lang", F.lit(" &amp; "), "source", F.lit("</h3><h2>Part "),
        "doc_id", F.lit("!</h2>")).alias("html"))


@query("section_overviews", """
WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS o FROM documents) SELECT doc_id, CASE WHEN length(o) > 40 THEN o END AS overview FROM t""")
def section_overviews(spark, sf):
    """B27."""
    return _marked(spark, sf).select("doc_id", S.overview(F.col("html")).alias("overview"))


@query("section_excerpts", f"""
WITH {inputs.LINES}, h AS (SELECT doc_id, order_index, trim(substr(body, 1, 300), '') AS h FROM lines),
r AS (SELECT *, coalesce(sum(length(h)) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM h)
SELECT doc_id, md5(string_agg(h, chr(10) || chr(10) ORDER BY order_index)) AS excerpt FROM r WHERE b < 3000 GROUP BY doc_id""")
def section_excerpts(spark, sf):
    """B29."""
    return table(spark, sf, "documents").select("doc_id", F.md5(S.excerpt_in_row(S.clean_lines(F.col("text")))).alias("excerpt"))


@query("section_offset_splits", """
SELECT doc_id, doc_id || '#' || p AS part_id, md5(CASE p WHEN 0 THEN substr(text, 1, (n_chars // 2)::BIGINT) ELSE substr(text, (n_chars // 2 + 1)::BIGINT) END) AS part
FROM documents, (SELECT unnest([0, 1]) AS p)""")
def section_offset_splits(spark, sf):
    """Every document cut at half its length."""
    d = table(spark, sf, "documents")
    half = F.floor(F.col("n_chars") / 2)
    cuts = d.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start_at"), half.alias("end_at")),
        F.struct(F.lit(1).alias("part"), half.alias("start_at"), F.lit(None).cast("bigint").alias("end_at")))).alias("c")).select(
        "doc_id", "c.*")
    return S.split_by_offsets(d.select("doc_id", "text"), cuts).select("doc_id", "part_id", F.md5("part_text").alias("part"))


# --- ingest tables ---------------------------------------------------------------------
_EXT = "CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.HTML' WHEN 2 THEN '.pdf' WHEN 3 THEN '.xyz' ELSE '_faq.txt' END"


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".HTML", ".pdf", ".xyz", "_faq.txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", ext).alias("source_path"),
                    F.when(F.col("doc_id") % 11 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"))


_MANIFEST = (f"manifest AS (SELECT doc_id, '/in/' || source || '/' || doc_id || {_EXT} AS source_path, "
             "CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS text FROM documents)")
_TYPED = (f"{_MANIFEST}, typed AS (SELECT *, CASE WHEN source_path LIKE '%.txt' THEN 'text' WHEN source_path LIKE '%.HTML' THEN 'html' "
          "WHEN source_path LIKE '%.pdf' THEN 'pdf' END AS content_type FROM manifest WHERE source_path NOT LIKE '%\\_faq.txt' ESCAPE '\\')")


@query("ingest_log", f"""
WITH {_TYPED} SELECT source_path, CASE WHEN content_type IS NULL OR trim(text, ' ' || chr(10)) = '' THEN 'skipped' ELSE 'ingested' END AS status,
  CASE WHEN content_type IS NULL THEN 'unsupported type' WHEN trim(text, ' ' || chr(10)) = '' THEN 'no text' ELSE '' END AS reason FROM typed""")
def ingest_log(spark, sf):
    """A2, A3, A7, A8."""
    typed = files.exclude_generated(files.with_content_type(_manifest(spark, sf), "source_path"), "source_path")
    return files.ingest_log(typed)


@query("ingest_summary", f"""
WITH {_TYPED}, s AS (SELECT CASE WHEN content_type IS NULL OR trim(text, ' ' || chr(10)) = '' THEN 'skipped' ELSE 'ingested' END AS s FROM typed)
SELECT count(*) FILTER (s = 'ingested') AS processed, count(*) FILTER (s = 'skipped') AS skipped, 0::BIGINT AS failed,
  (SELECT count(*) FROM manifest) AS total, round((SELECT count(*) FROM typed) / (SELECT count(*) FROM manifest) * 100, 1) AS percent FROM s""")
def ingest_summary(spark, sf):
    """A9, A10."""
    log = ingest_log(spark, sf)
    progress = files.ingest_progress(log, _manifest(spark, sf)).select("total", "percent")
    return files.ingest_summary(log).join(F.broadcast(progress))


@query("ingest_new_only", f"""
WITH {_MANIFEST} SELECT source_path FROM manifest WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def ingest_new_only(spark, sf):
    """A5: documents with a label count as indexed."""
    m = _manifest(spark, sf)
    return files.skip_indexed(m, m.join(table(spark, sf, "labels").select("doc_id"), "doc_id")).select("source_path")


@query("ingest_stale", f"""
WITH s AS (SELECT user_id, event_type, max(ts) AS m FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
v AS (SELECT user_id, m FROM s WHERE event_type = 'view'), c AS (SELECT user_id, m FROM s WHERE event_type = 'click')
SELECT v.user_id FROM v LEFT JOIN c USING (user_id) WHERE c.m IS NULL OR c.m < v.m""")
def ingest_stale(spark, sf):
    """Views as sources and clicks as derived artefacts of a user."""
    ev = table(spark, sf, "events")
    last = lambda kind: ev.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max("ts").alias("modificationTime"))
    return files.stale_only(last("view"), last("click"), "user_id").select("user_id")


@query("ingest_upsert", """
WITH u AS (SELECT vec_id, label, 0 AS s FROM embeddings UNION ALL SELECT doc_id, 100 + quality, 1 FROM labels)
SELECT vec_id, arg_max(label, s) AS label FROM u GROUP BY vec_id""")
def ingest_upsert(spark, sf):
    """Labels written over vectors by id."""
    batch = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), (F.lit(100) + F.col("quality")).cast("int").alias("label"))
    return files.upsert(table(spark, sf, "embeddings").select("vec_id", "label"), batch, "vec_id")


@query("ingest_deletes", f"""
WITH {inputs.LINES}, {inputs.GRANTS} SELECT 'documents' AS part, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'sections', count(*) FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'grants', count(*) FROM grants WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)""")
def ingest_deletes(spark, sf):
    """Toxic documents deleted with their sections and grants."""
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    left = files.delete_documents(gone, table(spark, sf, "documents"), inputs.lines(spark, sf), inputs.grants(spark, sf))
    out = None
    for name, t in zip(("documents", "sections", "grants"), left):
        part = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("ingest_bundles", f"""
WITH {SECTIONS}, b AS (SELECT doc_id, list(section_title ORDER BY order_index) AS t FROM sections GROUP BY doc_id)
SELECT d.doc_id, d.source, len(t) AS n_sections, array_to_string(t, '|') AS titles FROM documents d LEFT JOIN b USING (doc_id)""")
def ingest_bundles(spark, sf):
    """Documents with their sections nested."""
    d = table(spark, sf, "documents")
    s = S.sectionize_text(d.select("doc_id", "text"))
    return files.document_bundle(d.select("doc_id", "source"), s).select("doc_id", "source", F.when(
        F.col("sections").isNotNull(), F.size("sections")).alias("n_sections"), F.array_join(F.transform(
            "sections", lambda x: x["section_title"]), "|").alias("titles"))


@query("ingest_sections_of", f"""
WITH {inputs.LINES} SELECT section_id, order_index, 1.0::DOUBLE AS score FROM lines WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def ingest_sections_of(spark, sf):
    """A15 for documents of good quality."""
    ids = table(spark, sf, "labels").filter("quality = 1")
    return files.sections_of(inputs.lines(spark, sf), ids).select("section_id", "order_index", "score")


@query("ingest_counts", f"WITH {inputs.LINES} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS sections FROM lines")
def ingest_counts(spark, sf):
    """A16."""
    return files.corpus_counts(table(spark, sf, "documents"), inputs.lines(spark, sf))


@query("ingest_parts", f"""
WITH {inputs.TITLED}, l AS (SELECT doc_id, source_path, string_split(text, chr(10)) AS l FROM titled),
p AS (SELECT doc_id, source_path, unnest(range(0, len(l))) AS part, unnest(l) AS text FROM l)
SELECT doc_id, source_path AS original_source_path, source_path || '#' || part AS source_path, length(text) AS n_chars FROM p""")
def ingest_parts(spark, sf):
    """Each line of a document as a part of one workbook."""
    d = inputs.first_line_documents(spark, sf).select("doc_id", "source_path", F.split("text", "\n").alias("parts"))
    return files.explode_parts(d).select("doc_id", "original_source_path", "source_path", F.length("text").alias("n_chars"))


@query("ingest_messages", """
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE md5(text) END AS text, CASE WHEN turn % 5 = 4 THEN 'no source path' END AS error FROM conversations""")
def ingest_messages(spark, sf):
    """Turns as JSON messages, every third in base64, every fifth without a path."""
    c = table(spark, sf, "conversations")
    b64 = F.col("turn") % 3 == 0
    msg = F.to_json(F.struct(
        F.when(b64, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("content"),
        F.when(b64, "base64").otherwise("plain").alias("encoding"), F.lit("text").alias("content_type"),
        F.when(F.col("turn") % 5 != 4, F.concat(F.lit("/q/"), "conv_id", F.lit("/"), "turn")).alias("source_path")))
    parsed = messages.parse_messages(c.select("conv_id", "turn", msg.alias("value")))
    return parsed.select("conv_id", "turn", F.when(F.col("error").isNull(), F.md5("text")).alias("text"), "error")


@query("ingest_faq_rows", """
WITH v AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, source, unnest(range(0, least(len(l), 2))) AS n, unnest(l[1:2]) AS question FROM d)
SELECT p.doc_id, p.doc_id || '_faq_' || n AS faq_id, question, source AS answer, round(list_sum(embedding)::DOUBLE, 4) AS vector_sum FROM p JOIN v ON v.vec_id = p.doc_id % (SELECT count(*) FROM embeddings) WHERE n < 2""")
def ingest_faq_rows(spark, sf):
    """Lines as questions with two vectors each; the link of vectors to documents is synthetic."""
    d, v = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    docs = d.withColumn("vec_id", F.col("doc_id") % v.count()).join(v, "vec_id").select(
        "doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("question"), F.col("source").alias("answer"))).alias(
            "faq_pairs"), F.array("embedding", "embedding").alias("faq_vectors"))
    total = F.aggregate("question_embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.faq_rows(docs).select("doc_id", "faq_id", "question", "answer", F.round(total, 4).alias("vector_sum"))


@query("ingest_folder_scan", "SELECT doc_id, 'text' AS content_type, md5(text) AS text, true AS named FROM documents")
def ingest_folder_scan(spark, sf):
    """A1-A4: all documents written out as text files, the folder scanned and decoded, the rows read back."""
    path = session_dir(spark)
    files.write_lines(table(spark, sf, "documents").select("doc_id", "text"), path)
    found = files.read_documents(spark, path).select("source_path", "content_type", "text")
    return files.read_lines(found, "doc_id long, text string").select(
        "doc_id", "content_type", F.md5("text").alias("text"), F.col("source_path").endswith(".txt").alias("named"))


@query("ingest_exported", "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents")
def ingest_exported(spark, sf):
    """Documents exported as CSV and read back, line ends, quotes and blanks unchanged."""
    path, docs = session_dir(spark), table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    files.export_csv(docs, path)
    return files.read_csv(spark, path, docs.schema).withColumn("text", F.md5("text"))
