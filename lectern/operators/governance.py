"""Governance attributes, regulation tags, role mentions and the improvement report.

Rules are ordered lists of (label, phrases).  They are small literals of the plan, so each
attribute is a chain of conditions on the row itself.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions.hof import any_contains, let, lits
from lectern.functions.text import head, strip_tags, words

Rules = Sequence[tuple[str, Sequence[str]]]

# --- fixed values: ordered rules, label then phrases ---------------------------
DOC_TYPE_RULES: Rules = (
    ("SOP", ("sop",)), ("Checklist", ("checklist",)), ("Guideline", ("guideline",)),
    ("Procedure", ("procedure",)), ("Framework", ("framework",)), ("Inventory Register", ("inventory",)),
    ("Drill Record", ("drill",)), ("Job Description", ("jd",)), ("Playbook", ("playbook",)),
    ("Continuity Plan", ("plan",)),
)
AUDIENCE_RULES: Rules = (
    ("All Employees", ("clear-desk", "remote-working", "wfh", "modern-slavery", "anti-trust",
                       "ethical-sourcing", "disease-response", "employee-onboarding",
                       "information-security-and-employe")),
    ("HR Team, Hiring Managers", ("recruitment", "onboarding", "background")),
    ("Leadership, HR", ("ciso-jd",)),
    ("Development Team", ("coding", "sdl", "system-acquisition", "garbage-collection")),
    ("DevOps / Cloud Engineers", ("aws-security", "cloud", "server-hardening", "infra", "sso",
                                  "url-whitelist", "obtain-or-review", "rto-rpo", "resiliency",
                                  "contingency")),
    ("Security Operations Team", ("siem", "log-monitor", "monthly-log", "ir-playbook",
                                  "incident-management", "threat-response", "network-vuln",
                                  "vulnerability-assessment", "security-hardening-baseline")),
    ("IT Asset Managers, IT Team", ("asset", "inventory", "license")),
    ("Sales, Marketing, Legal", ("marketing", "selling", "anti-trust", "compliance-program")),
    ("Legal, Compliance Team", ("outsourc", "sar-reports", "customer-data", "customer data")),
    ("QA Team, Project Managers", ("quality", "document-for-quality")),
    ("All Employees, Legal", ("intellectual-property", "ipr")),
    ("IT Team, All Employees", ("dlp", "encryption", "web-application-security", "cyber-security",
                                "user-lifecyle", "sop-iam")),
)
CATEGORY_RULES: Rules = (
    ("Legal & Compliance", ("anti-trust", "compliance-program", "outsourc", "sar", "customer-data",
                            "modern-slavery", "ethical", "guidelines-and-process-for-management")),
    ("HR & Employee Policies", ("onboarding", "recruitment", "wfh", "remote-working", "clear-desk",
                                "background", "disease-response")),
    ("IT Asset Management", ("asset", "inventory", "license")),
    ("Security Operations", ("siem", "log", "monitoring", "ir-playbook", "incident")),
    ("Cloud & Infrastructure", ("aws", "cloud", "server", "infra", "sso", "url-whitelist",
                                "obtain-or-review")),
    ("Software Development", ("coding", "sdl", "system-acquisition", "garbage")),
    ("Business Continuity", ("rto", "rpo", "continuity", "resiliency", "trrp", "contingency", "disease")),
    ("Quality Assurance", ("quality", "qa", "document-for-quality")),
    ("Intellectual Property", ("intellectual", "ipr")),
    ("Talent & Organisation", ("tech-recruit",)),
)
OWNER_RULES: Rules = (
    ("CISO", ("ciso",)), ("HR Manager", ("recruitment", "onboarding", "background")),
    ("IT Asset Manager / CISO", ("asset", "inventory", "license")),
    ("CTO / DevOps Lead", ("cloud", "aws", "server", "infra", "rto", "trrp", "contingency")),
    ("Engineering Lead", ("coding", "sdl", "system-acquisition", "garbage")), ("QA Manager", ("quality",)),
    ("Legal / Compliance Officer", ("marketing", "selling", "anti-trust", "modern-slavery", "ethical", "sar",
                                    "customer-data", "outsourc")),
    ("Security Operations Manager", ("siem", "log", "monitoring", "ir-playbook")),
)
GOVERNANCE = {"doc_type": (DOC_TYPE_RULES, "Policy"), "audience": (AUDIENCE_RULES, "IT Team, Management"),
              "category": (CATEGORY_RULES, "Information Security"), "owner": (OWNER_RULES, "CISO / CTO")}
REVIEW_CYCLES = {"Checklist": "Quarterly", "Drill Record": "Quarterly", "Inventory Register": "Monthly",
                 "SOP": "Semi-Annual", "Procedure": "Semi-Annual"}
NAME_STOPWORDS = ("product", "solutions", "private", "limited", "policy", "sop", "procedure", "management",
                  "process", "platform", "html", "the", "and", "for", "with", "from", "into", "this", "that",
                  "are", "its", "standard", "operating", "document", "guidelines", "checklist", "version")
CLASSIFICATION_RULES: Rules = (
    ("STRICTLY CONFIDENTIAL", ("salary", "compensation", "personal", "posh", "disciplinary", "termination",
                               "strictly")),
    ("CONFIDENTIAL", ("security", "password", "vpn", "encryption", "incident", "vulnerability", "firewall")),
    ("CUSTOMER SHAREABLE", ("public", "customer shareable", "external")),
)
ROLE_DUTIES: Sequence[tuple[str, str, str]] = (
    ("ciso", "CISO", "Overall policy ownership; security enforcement; exception approvals"),
    ("cto", "CTO", "Technology infrastructure; tool provisioning; policy ratification"),
    ("hr manager", "HR Manager", "Employee communication; onboarding; disciplinary process"),
    ("employee", "All Employees", "Read, understand, and comply with this policy"),
    ("supervisor", "Supervisor / Manager", "Approve requests; monitor team compliance; escalate incidents"),
    ("it team", "IT / DevOps Team", "Implement technical controls; maintain systems per policy"),
    ("compliance", "Compliance Manager", "Audit compliance; report to leadership; manage exceptions"),
    ("internal audit", "Internal Audit", "Independent verification of policy adherence"),
)


def first_rule(text: Column, rules: Rules, default: str) -> Column:
    """Label of the first rule with a phrase inside the text, else the default."""
    out = F.lit(None).cast("string")
    for name, phrases in rules:
        out = F.coalesce(out, F.when(any_contains(text, phrases), F.lit(name)))
    return F.coalesce(out, F.lit(default))


def governance(docs: DataFrame, name: str = "file_name", text: str = "text",
               rules: Mapping[str, tuple[Rules, str]] = GOVERNANCE, chars: int | None = None) -> DataFrame:
    """Document type, audience (also from the text, or its first ``chars`` characters), category, owner, review."""
    low = F.lower(F.col(name))
    out = docs
    for column, (ordered, default) in rules.items():
        where = F.concat(low, F.lower(head(F.col(text), chars))) if column == "audience" else low
        out = out.withColumn(column, first_rule(where, ordered, default))
    return out.withColumn("review_cycle", review_cycle(F.col("doc_type")))


def review_cycle(doc_type: Column) -> Column:
    """D15."""
    out = F.lit("Annual")
    for kind, cycle in REVIEW_CYCLES.items():
        out = F.when(doc_type == kind, cycle).otherwise(out)
    return out


def filename_keywords(name: Column, stopwords: Sequence[str] = NAME_STOPWORDS, limit: int = 7) -> Column:
    """Words over three characters outside the stop list, the first seven."""
    plain = F.regexp_replace(F.lower(F.replace(name, F.lit(".html"), F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.array_join(F.slice(F.filter(words(plain), lambda w: (F.length(w) > 3) & ~w.isin(*stopwords)),
                                1, limit), ", ")


def _search(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def effective_date(name: Column, text: Column, fallbacks: Mapping[str, str] | None = None) -> Column:
    """struct<date, inferred>; body patterns in order, then a file-name key, then the constant."""
    body = F.coalesce(*[_search(text, p) for p in fixed.BODY_DATES])
    low = F.lower(name)
    keyed = [F.when(low.contains(k), F.lit(v)) for k, v in (fallbacks or {}).items()]
    return F.struct(F.coalesce(body, *keyed, F.lit(fixed.DEFAULT_DATE)).alias("date"),
                    body.isNull().alias("inferred"))


def governance_version(name: Column, text: Column) -> Column:
    """``version N`` in the text, then in the file name, else v1.0."""
    return F.concat(F.lit("v"), F.coalesce(_search(text, r"[Vv]ersion\s+(\d+[\d.]*)"),
                                           _search(name, r"(?i)v[.\s]*(\d+[\d.]+)"), F.lit("1.0")))


def classification(name: Column, text: Column, rules: Rules = CLASSIFICATION_RULES, chars: int | None = None) -> Column:
    """Sensitivity class from the name and the text (its first ``chars`` characters)."""
    return first_rule(F.lower(F.concat(name, head(text, chars))), rules, "INTERNAL USE ONLY")


ELEMENT = r"(?i)<(?:p|li)[^>]*>[^<]*(?:<(?!/?(?:p|li)\b)[^>]*>[^<]*)*</(?:p|li)>"


def regulation_tags(docs: DataFrame, html: str = "html", key: str = "doc_id",
                    patterns: Sequence[tuple[str, str]] = fixed.REGULATIONS,
                    max_bytes: int | None = None) -> DataFrame:
    """One row per paragraph or list item with the first matching regulation.

    All documents by default; with ``max_bytes`` longer ones are passed over.
    """
    if max_bytes is not None:
        docs = docs.filter(F.octet_length(html) <= max_bytes)
    units = docs.select(key, F.posexplode(
        F.regexp_extract_all(F.col(html), F.lit(ELEMENT), F.lit(0))).alias("pos", "element"))
    first = F.coalesce(*[F.when(F.col("element").rlike("(?i)" + p), F.lit(ref)) for p, ref in patterns])
    return units.withColumn("regulation", first).filter(F.col("regulation").isNotNull())


def role_mentions(docs: DataFrame, html: str = "html", key: str = "doc_id",
                  duties: Sequence[tuple[str, str, str]] = ROLE_DUTIES) -> DataFrame:
    """Role rows; only with two or more roles and no responsibilities section yet."""
    low = F.lower(strip_tags(F.col(html)))
    found = let(low, lambda t: F.array_compact(F.array(*[F.when(t.contains(word), F.struct(
        F.lit(n).alias("pos"), F.lit(role).alias("role"), F.lit(duty).alias("duty")))
        for n, (word, role, duty) in enumerate(duties)])))
    return (docs.filter(~F.col(html).rlike(r"(?i)roles?\s*(?:and|&amp;)\s*responsibilit"))
            .select(key, found.alias("r")).filter(F.size("r") >= 2)
            .select(key, F.explode("r").alias("r")).select(key, "r.*"))


def related_from_map(name: Column, category: Column, related: Mapping[str, Sequence[str]]) -> Column:
    """D22, fixed map: listed titles of the category whose start is not the start of the file name."""
    clean = F.substring(F.lower(F.translate(F.replace(name, F.lit(".html"), F.lit("")), "-", " ")), 1, 20)
    table = F.create_map(*[x for k, v in related.items() for x in (F.lit(k), lits(v))])
    return F.filter(F.coalesce(F.try_element_at(table, category), lits(())),
                    lambda p: ~clean.contains(F.substring(F.lower(p), 1, 20)))


def related_documents(docs: DataFrame, key: str = "doc_id", category: str = "category", title: str = "title",
                      per_category: int = 5) -> DataFrame:
    """D22, from data: up to ``per_category`` first titles of the same category, without the document itself.

    The list of a category is cut before it is joined, so a huge category costs no more than a small one.
    """
    heads = _first_titles(docs, category, title, per_category + 1)
    return docs.join(heads, category, "left").withColumn("related", F.slice(F.filter(
        "_t", lambda t: t != F.col(title)), 1, per_category)).drop("_t")


def _first_titles(docs: DataFrame, category: str, title: str, k: int) -> DataFrame:
    w = Window.partitionBy(category).orderBy(title)
    return (docs.select(category, title).distinct().withColumn("_n", F.row_number().over(w))
            .filter(F.col("_n") <= k).groupBy(category).agg(F.sort_array(F.collect_list(title)).alias("_t")))


def superseded(docs: DataFrame, replacements: DataFrame, name: str = "file_name") -> DataFrame:
    """replacements(old_name, new_name) -> status and the replacement of a document."""
    return docs.join(replacements.withColumnRenamed("old_name", name), name, "left").withColumn(
        "status", F.when(F.col("new_name").isNotNull(), "superseded").otherwise("current"))


def markup_title(html: Column, name: Column) -> Column:
    """Large or coloured span (over 6 characters), title element (over 3), else the file name."""
    span = strip_tags(F.regexp_extract(
        html, r"(?is)<span[^>]*(?:font-size:2[0-9]pt|color:#0070c0)[^>]*>(.*?)</span>", 1))
    title = strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    stem = F.regexp_replace(F.replace(name, F.lit(".html"), F.lit("")), r"-v[\d.]+$", "")
    return F.coalesce(F.when(F.length(span) > 6, span), F.when(F.length(title) > 3, title),
                      F.initcap(F.translate(stem, "-", " ")))


def improvement_report(docs: DataFrame, name: str = "file_name", text: str = "text",
                       fallbacks: Mapping[str, str] | None = None, weak_titles: Sequence[str] = (),
                       rules: Mapping[str, tuple[Rules, str]] = GOVERNANCE, chars: int | None = None) -> DataFrame:
    """One row per file with its inferred attributes and notes, ``Clean`` when there are none."""
    n, t = F.col(name), F.col(text)
    kb = F.floor(F.octet_length(t) / 1024)
    dated = governance(docs, name, text, rules).withColumn("_d", effective_date(n, t, fallbacks))
    notes = F.concat_ws(
        "; ",
        F.when(F.col("_d.inferred"), F.concat(F.lit("Effective date not found in body — assigned "), F.col("_d.date"))),
        F.when(kb > 100, F.concat(F.lit("Large document ("), kb.cast("string"),
                                  F.lit(" KB) — consider further splitting by section"))),
        F.when(n.isin(*weak_titles) if weak_titles else F.lit(False), F.lit(
            "Title begins with company name — consider a more specific document title")))
    return dated.select(
        F.col(name).alias("source"), F.lit("Improved — metadata banner added").alias("action"), "doc_type",
        governance_version(n, t).alias("version"), F.col("_d.date").alias("date"), "owner", "audience",
        "category", filename_keywords(n).alias("keywords"), "review_cycle",
        F.coalesce(F.nullif(notes, F.lit("")), F.lit("Clean")).alias("notes"))
