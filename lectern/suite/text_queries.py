"""Text functions over whole tables."""
from pyspark.sql import functions as F

from lectern.functions import fixed, text as T
from lectern.functions.lexicon import labels
from lectern.suite import inputs, query, sql, table

MASKS = {"the": "TTT", "and": "&&&", "The": "TTT"}


@query("text_tokens", f"""
WITH t AS (SELECT doc_id, {sql.norm('text')} AS n, {sql.tokens('text')} AS toks, {sql.kept('text')} AS k FROM documents),
u AS (SELECT doc_id, n, toks, {sql.with_pairs('k')} AS terms FROM t)
SELECT doc_id, md5(n) AS normalized, len(toks) AS n_tokens, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct,
  len(list_filter(list_distinct(terms), lambda x: {sql.informative('x')})) AS n_informative,
  md5({sql.joined('terms', ' ')}) AS terms FROM u""")
def text_tokens(spark, sf):
    """C1-C4, C6."""
    terms = F.col("terms")
    return table(spark, sf, "documents").select(
        "doc_id", T.normalize_text(F.col("text")).alias("n"), T.tokenize(F.col("text")).alias("toks"),
        T.keywordize(F.col("text")).alias("terms")).withColumn("u", T.uniq(terms)).select(
        "doc_id", F.md5("n").alias("normalized"), F.size("toks").alias("n_tokens"), F.size(terms).alias("n_terms"),
        F.size("u").alias("n_distinct"), F.size(T.informative(F.col("u"))).alias("n_informative"),
        F.md5(F.array_join(terms, " ")).alias("terms"))


@query("text_humanized_terms", f"""
WITH t AS (SELECT lang, unnest({sql.kept('text')}) AS t FROM documents),
p AS (SELECT lang, {sql.kept('text')} AS k FROM documents), b AS (SELECT lang, unnest({sql.pairs('k')}) AS t FROM p)
SELECT lang, replace(t, '_', ' ') AS term, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM b)
GROUP BY 1, 2""")
def text_humanized_terms(spark, sf):
    """Terms per language, written for people."""
    return table(spark, sf, "documents").select("lang", F.explode(T.keywordize(F.col("text"))).alias("t")).groupBy(
        "lang", "t").agg(F.count("*").alias("n")).select("lang", T.humanize(F.col("t")).alias("term"), "n")


@query("text_lexicon_labels", f"""
WITH t AS (SELECT doc_id, {sql.norm('text')} AS n, list_distinct({sql.tokens('text')}) AS toks FROM documents)
SELECT doc_id, {sql.joined(sql.labels('n', 'toks', inputs.LEXICON))} AS labels,
  {sql.joined(sql.labels('n', 'toks', fixed.SECTION_TYPES))} AS section_labels FROM t""")
def text_lexicon_labels(spark, sf):
    """C7 with a lexicon of the corpus and with the section lexicon."""
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(labels(F.col("text"), inputs.LEXICON), "|").alias("labels"),
        F.array_join(labels(F.col("text"), fixed.SECTION_TYPES), "|").alias("section_labels"))


def _replace(x, pattern, fn):
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, {sql.q(pattern)}), list_concat("
            f"regexp_extract_all({x}, {sql.q(pattern)}), [''])), lambda z: z[1] || {fn('z[2]')}), '')")


def _scaled(factor):
    return lambda m: (f"(CASE WHEN {m} = '' THEN '' ELSE trunc(regexp_extract({m}, '\\d+(?:\\.\\d+)?')::DOUBLE * "
                      f"{factor}::DOUBLE)::BIGINT::VARCHAR END)")


def _nums(source):
    steps = [("s0", f"SELECT query_id, question, regexp_replace(question, '[₹$€£]', '', 'g') AS x FROM {source}")]
    comma = lambda m: f"replace({m}, ',', '')"
    for pattern, fn in ((r"\b\d{1,2}(?:,\d{2})+(?:,\d{3})?\b", comma), (r"\b\d{1,3}(?:,\d{3})+\b", comma),
                        (r"(?i)\d+(?:\.\d+)?\s*(?:cr(?:ore)?s?)\b", _scaled(10000000)),
                        (r"(?i)\d+(?:\.\d+)?\s*(?:lakh|lakhs|lac|lacs)\b", _scaled(100000)),
                        (r"\d+(?:\.\d+)?L\b", _scaled(100000)),
                        (r"(?i)\d+(?:\.\d+)?\s*(?:thousand|k)\b", _scaled(1000))):
        steps.append((f"s{len(steps)}", f"SELECT query_id, question, {_replace('x', pattern, fn)} AS x FROM s{len(steps) - 1}"))
    return ", ".join(f"{n} AS ({s})" for n, s in steps), f"s{len(steps) - 1}"


NUMBERS, NUMBERED = _nums("questions")


@query("text_numbers", f"WITH {inputs.QUESTIONS}, {NUMBERS} SELECT query_id, x AS normalized FROM {NUMBERED}")
def text_numbers(spark, sf):
    """C8."""
    return inputs.questions(spark, sf).select("query_id", T.normalize_numbers(F.col("question")).alias("normalized"))


_MASK = "replace(replace(replace(text, 'the', 'TTT'), 'and', '&&&'), 'The', 'TTT')"


@query("text_masking", f"""
SELECT doc_id, md5({_MASK}) AS masked, md5(replace(replace({_MASK}, 'TTT', 'the'), '&&&', 'and')) AS unmasked FROM documents""")
def text_masking(spark, sf):
    """C9, C10."""
    masked = T.mask(F.col("text"), MASKS)
    return table(spark, sf, "documents").select("doc_id", F.md5(masked).alias("masked"),
                                                F.md5(T.unmask(masked, MASKS)).alias("unmasked"))


_V = fixed.VERSION
_D = fixed.DATE


@query("text_title_parts", f"""
WITH {inputs.TITLED}, t AS (SELECT doc_id, text, title || ' Final_Major Version v' || (doc_id % 7) || '.' || (doc_id % 3)
  || ' - 12 March 20' || (10 + doc_id % 15) AS title FROM titled),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql.norm('title')},
  {sql.q(_V)}, '', 'gi'), {sql.q(_D)}, '', 'gi'), '\\bmajor version\\b', '', 'g'), '\\bfinal\\b', '', 'g'), '[_\\-]+', ' ', 'g') AS c FROM t)
SELECT doc_id, {sql.collapse('c')} AS canonical, regexp_extract(title || chr(10) || text, {sql.q('(?i)' + _V)}, 1) AS version,
  trim(regexp_extract(title || chr(10) || text, {sql.q('(?i)' + _D)})) AS dated,
  make_date(2010 + doc_id % 15, 3, 12)::VARCHAR AS parsed FROM c""")
def text_title_parts(spark, sf):
    """Canonical title, version and date of titles with all of them."""
    d = inputs.first_line_documents(spark, sf)
    title = F.concat("title", F.lit(" Final_Major Version v"), F.col("doc_id") % 7, F.lit("."), F.col("doc_id") % 3,
                     F.lit(" - 12 March 20"), F.lit(10) + F.col("doc_id") % 15)
    # the day stands apart from the month here, so the written date is month and year; the day is added for parsing
    out = d.select("doc_id", "text", title.alias("title")).select(
        "doc_id", T.canonical_title(F.col("title")).alias("canonical"),
        T.extract_version(F.col("title"), F.col("text")).alias("version"),
        T.extract_date(F.col("title"), F.col("text")).alias("dated"))
    return out.withColumn("parsed", T.parsed_date(F.concat(F.lit("12 "), "dated")).cast("string"))


_ANSWER = ("'<think>' || conv_id || '</think>Answer (D1:S2.E3)' || chr(10) || text || chr(10) || 'Source: file ' || turn || "
           "chr(10) || '[D2:S1] note []' || chr(10) || '- ' || chr(10) || chr(10) || 'Reference: ' || text")


def _sanitize(source):
    x = "trim(x, ' ' || chr(9) || chr(10) || chr(13))"
    for tag in T.REASONING:
        x = f"regexp_replace({x}, {sql.q(f'(?is)<{tag}' + chr(92) + 'b[^>]*>.*?</' + tag + '>')}, '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:reasoning|thinking|think|analysis)\\b[^>]*>', '', 'g')"
    for pattern, to in fixed.SANITIZE_STEPS:
        if "(?=" in pattern:        # no look-ahead in this engine: what follows is taken and put back
            pattern, to = pattern.replace("(?=", "("), to + "$1"
        x = f"regexp_replace({x}, {sql.q(pattern)}, {sql.q(to.replace('$', chr(92)))}, 'g')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


@query("text_sanitized_answers", f"""
WITH a AS (SELECT conv_id, turn, {_ANSWER} AS x FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, {_sanitize('x')} AS s FROM a)
SELECT conv_id, turn, md5(s) AS clean, length(s) AS n_chars,
  md5(regexp_replace(s, '(?is)\\n{{2,}}Reference:\\s.*$', '')) AS compact FROM s""")
def text_sanitized_answers(spark, sf):
    """Answers with reasoning, ids and source lines added, cleaned again."""
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    nl = "\n"
    x = F.concat(F.lit("<think>"), "conv_id", F.lit(f"</think>Answer (D1:S2.E3){nl}"), "text", F.lit(f"{nl}Source: file "),
                 "turn", F.lit(f"{nl}[D2:S1] note []{nl}- {nl}{nl}Reference: "), "text")
    s = T.sanitize_answer(x)
    return c.select("conv_id", "turn", s.alias("s"), T.compact_message(x).alias("c")).select(
        "conv_id", "turn", F.md5("s").alias("clean"), F.length("s").alias("n_chars"), F.md5("c").alias("compact"))


_W = "\\pL\\pN_"
_BEFORE = f"NOT regexp_matches(p[{{0}}], '[<{_W}]$') AND NOT regexp_matches(p[{{1}}], '^[>{_W}/]')"
_LEAD = (f"regexp_replace(regexp_replace(p[i], '^\\s*(\\s[>{_W}/])', '\\1'), '^\\s+([^>{_W}/\\s])', '\\1')")
_TRAIL = f"regexp_replace(regexp_replace(x, '([<{_W}]\\s)\\s*$', '\\1'), '([^<{_W}\\s])\\s+$', '\\1')"
# bars: the text between two bars loses the blanks that the replaced bar takes with it
_BARS = f"""list_transform(range(1, len(p) + 1), lambda i: CASE WHEN regexp_full_match(p[i], '\\s*') AND len(p) > 1 THEN ''
  ELSE list_transform([CASE WHEN i > 1 AND {_BEFORE.format('i - 1', 'i')} THEN {_LEAD} ELSE p[i] END],
    lambda x: CASE WHEN i < len(p) AND {_BEFORE.format('i', 'i + 1')} THEN {_TRAIL} ELSE x END)[1] END
  || CASE WHEN i < len(p) AND {_BEFORE.format('i', 'i + 1')} THEN ' / ' ELSE '' END)"""


@query("text_markdown", f"""
WITH a AS (SELECT doc_id, '#### Head ' || source || chr(10) || '---' || chr(10) || 'SOURCE: x' || chr(10) || text AS x FROM documents),
l AS (SELECT doc_id, list_transform(list_filter(string_split(x, chr(10)), lambda s: NOT regexp_full_match(trim(s), '[-*_]{{3,}}')
  AND NOT starts_with(lower(trim(s)), 'source:') AND NOT starts_with(lower(trim(s)), '_source:')),
  lambda s: CASE WHEN regexp_full_match(s, '#{{4,}}\\s*(.+)') THEN '### ' || trim(regexp_extract(s, '^#{{4,}}\\s*(.+)$', 1)) ELSE rtrim(s) END) AS l FROM a),
t AS (SELECT doc_id, l[1] AS head, string_split(regexp_replace(array_to_string(l, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '|') AS p FROM l)
SELECT doc_id, md5({sql.strip(f"array_to_string({_BARS}, '')")}) AS clean, head FROM t""")
def text_markdown(spark, sf):
    """C16."""
    d = table(spark, sf, "documents")
    x = T.normalize_markdown(F.concat(F.lit("#### Head "), "source", F.lit("\n---\nSOURCE: x\n"), "text"))
    return d.select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("clean"),
                                                   F.element_at(F.split("x", "\n"), 1).alias("head"))


@query("text_links", """
SELECT page_id, lower(url) AS path_key, '/api/documents/open?path=' || url_encode(url) AS open_link,
  '/api/documents/view?path=' || url_encode(url) || '&section_index=' || (page_id % 9) || '&section_title='
  || url_encode(regexp_extract(html, '<title>(.*?)</title>', 1)[1:200]) AS view_link FROM pages""")
def text_links(spark, sf):
    """C18, C26."""
    p = table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return p.select("page_id", T.path_key(F.col("url")).alias("path_key"), T.open_link(F.col("url")).alias("open_link"),
                    T.view_link(F.col("url"), F.col("page_id") % 9, title).alias("view_link"))


@query("text_short_labels", f"""
SELECT conv_id, turn, {sql.truncate('text', 56)} AS title, {sql.truncate('text', 90)} AS topic, {sql.truncate('text', 96)} AS preview,
  {sql.est_tokens('text')} AS tokens FROM conversations""")
def text_short_labels(spark, sf):
    """C19, B18, B24."""
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.label(t).alias("title"), T.label(t, 90).alias(
        "topic"), T.truncate(t, 96).alias("preview"), T.estimate_tokens(t).alias("tokens"))


FAQ = ("faq_text AS (SELECT conv_id, 'Source: conv/' || conv_id || '.txt' || chr(10) || chr(10) || string_agg(CASE WHEN role = 'user' "
       "THEN 'Q: ' || replace(text, chr(10), ' ') ELSE 'A: ' || text || chr(10) END, chr(10) ORDER BY turn) AS faq "
       "FROM conversations WHERE role <> 'system' GROUP BY conv_id)")


def faq_texts(spark, sf):
    """Question-and-answer text per conversation."""
    c = table(spark, sf, "conversations").filter("role <> 'system'")
    line = F.when(F.col("role") == "user", F.concat(F.lit("Q: "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(
        F.concat(F.lit("A: "), "text", F.lit("\n")))
    return c.groupBy("conv_id").agg(F.concat(F.lit("Source: conv/"), F.first("conv_id"), F.lit(".txt\n\n"), F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n")).alias("faq"))


# pairs of a FAQ text: blocks start at Q:, the answer at the last A: of a block
PAIRS = f"""{FAQ}, faq_lines AS (SELECT conv_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (
  SELECT conv_id, list_transform(string_split(faq, chr(10)), lambda s: rtrim(s)) AS l FROM faq_text)),
faq_blocks AS (SELECT *, sum(CASE WHEN starts_with(trim(line), 'Q:') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM faq_lines),
faq_marked AS (SELECT *, max(CASE WHEN starts_with(trim(line), 'A:') THEN i END) OVER (PARTITION BY conv_id, b) AS a,
  min(i) OVER (PARTITION BY conv_id, b) AS q FROM faq_blocks WHERE b > 0),
faq_all AS (SELECT conv_id, b, trim(max(CASE WHEN i = q THEN substr(trim(line), 3) END)) AS question,
  trim(string_agg(CASE WHEN i = a THEN trim(substr(trim(line), 3)) ELSE line END, chr(10) ORDER BY i) FILTER (i >= a), ' ' || chr(10)) AS answer
  FROM faq_marked GROUP BY conv_id, b),
faq_pairs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY b) - 1 AS n, question, answer FROM faq_all
  WHERE question <> '' AND answer <> '')"""


@query("text_faq_pairs", f"WITH {PAIRS} SELECT conv_id, n, question, answer FROM faq_pairs")
def text_faq_pairs(spark, sf):
    """C21."""
    return faq_texts(spark, sf).select("conv_id", F.posexplode(T.parse_faq(F.col("faq"))).alias("n", "p")).select(
        "conv_id", "n", "p.question", "p.answer")


_PROFILE = ("CASE event_id % 4 WHEN 0 THEN 'Role: ' || event_type || ' Lead; Grade: M' || user_id || '; Location: City' || (user_id % 9) "
            "WHEN 1 THEN 'I''m a ' || event_type || ' manager in Unit ' || user_id || ' at Town' || (user_id % 7) "
            "WHEN 2 THEN 'the ' || event_type || ' analyst' ELSE 'what is ' || event_type || '?' END")


@query("text_profiles", f"""
WITH p AS (SELECT event_id, event_id % 4 AS k, event_type AS e, user_id AS u, {_PROFILE} AS x FROM events)
SELECT event_id, CASE k WHEN 0 THEN e || ' Lead' WHEN 1 THEN e || ' manager' WHEN 2 THEN e || ' analyst' ELSE '' END AS role,
  CASE k WHEN 0 THEN 'M' || u ELSE '' END AS grade, CASE k WHEN 1 THEN 'Unit ' || u ELSE '' END AS department,
  CASE k WHEN 0 THEN 'City' || (u % 9) WHEN 1 THEN 'Town' || (u % 7) ELSE '' END AS location,
  CASE k WHEN 0 THEN e || '|lead|' || e || ' lead|m' || u || '|city' || (u % 9)
    WHEN 1 THEN e || '|manager|' || e || ' manager|unit|' || u || '|unit ' || u || '|town' || (u % 7)
    WHEN 2 THEN e || '|analyst|' || e || ' analyst' ELSE '' END AS tags,
  CASE k WHEN 0 THEN e || ' Lead | M' || u || ' | Base | City' || (u % 9) WHEN 1 THEN e || ' manager | Unit ' || u || ' | Town' || (u % 7)
    WHEN 2 THEN e || ' analyst | Base' ELSE 'Guest | Base' END AS merged FROM p""")
def text_profiles(spark, sf):
    """C22-C24."""
    e, u, k = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 4
    x = (F.when(k == 0, F.concat(F.lit("Role: "), e, F.lit(" Lead; Grade: M"), u, F.lit("; Location: City"), F.col("user_id") % 9))
         .when(k == 1, F.concat(F.lit("I'm a "), e, F.lit(" manager in Unit "), u, F.lit(" at Town"), F.col("user_id") % 7))
         .when(k == 2, F.concat(F.lit("the "), e, F.lit(" analyst"))).otherwise(F.concat(F.lit("what is "), e, F.lit("?"))))
    base = F.struct(F.lit("Guest").alias("role"), F.lit("").alias("grade"), F.lit("Base").alias("department"), F.lit("").alias("location"))
    return table(spark, sf, "events").select("event_id", T.parse_profile(x).alias("p")).select(
        "event_id", "p.*", F.array_join(T.profile_tags(F.col("p")), "|").alias("tags"),
        T.profile_line(T.merge_profile(F.col("p"), base)).alias("merged"))


@query("text_embedding_layout", f"""
WITH {inputs.TITLED} SELECT doc_id, md5(trim(concat_ws(chr(10), nullif(title, ''), nullif({sql.truncate('text', 100)}, ''),
  {sql.strip('text')}))) AS layout FROM titled""")
def text_embedding_layout(spark, sf):
    """C25."""
    d = inputs.first_line_documents(spark, sf)
    return d.select("doc_id", F.md5(T.embedding_text(F.col("title"), T.truncate(F.col("text"), 100), F.col("text"))).alias("layout"))
