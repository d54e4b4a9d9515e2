"""Access grants and row-level visibility.  A grant on ``*`` makes an administrator."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.common import broadcast_if_small, store

ADMIN = "*"
EVERYTHING = "*"


def grant(grants: DataFrame, users: DataFrame, docs: DataFrame, at, cell_rows: int = 5_000) -> DataFrame:
    """H1: every listed user gets every listed document; a repeated grant keeps one row, the latest.

    The product of the two lists is the grant itself.  Both are dealt into groups of about ``cell_rows``, and each pair
    of groups is a key of an equi-join, so no task holds more than such a pair.
    """
    left = users.select(F.col("user_id").cast("string")).dropna().distinct()
    right = docs.select(F.col("doc_id").cast("string")).dropna().distinct()
    groups = [max(1, -(-df.count() // cell_rows)) for df in (left, right)]

    def dealt(df: DataFrame, column: str, own: int) -> DataFrame:
        mine, other = f"_{own}", f"_{1 - own}"
        return df.withColumn(mine, F.pmod(F.xxhash64(column), F.lit(groups[own]))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups[1 - own] - 1).cast("long"))))
    new = dealt(left, "user_id", 0).join(dealt(right, "doc_id", 1), ["_0", "_1"]).select(
        "user_id", "doc_id", F.lit(at).cast("timestamp").alias("granted_at"))
    return latest(grants.unionByName(new))


def bulk_counts(grants: DataFrame, users: DataFrame, docs: DataFrame, at) -> DataFrame:
    """H1: per user ``n_grants`` and ``fresh`` (last granted at ``at``) after `grant`, without its product.

    A bulk grant is its two lists: a listed user holds every listed document, so only the grants that were there before
    are rows, and the work grows with the lists and not with their product.
    """
    when = F.lit(at).cast("timestamp")
    listed = users.select(F.col("user_id").cast("string")).dropna().distinct().withColumn("_listed", F.lit(True))
    some = docs.select(F.col("doc_id").cast("string")).dropna().distinct().withColumn("_some", F.lit(True))
    n = F.lit(some.count())
    old, both = F.col("granted_at"), F.coalesce("_some", F.lit(False))
    own = latest(grants).join(some, "doc_id", "left").groupBy("user_id").agg(
        F.count("*").alias("_n"), F.count_if(both).alias("_both"), F.count_if(old == when).alias("_at"),
        F.count_if(both & (old == when)).alias("_again"), F.count_if(both & (old > when)).alias("_later"))
    c = lambda name: F.coalesce(name, F.lit(0))
    given = F.coalesce("_listed", F.lit(False))
    return own.join(listed, "user_id", "full").select(
        "user_id", (c("_n") + F.when(given, n - c("_both")).otherwise(0)).alias("n_grants"),
        (c("_at") + F.when(given, n - c("_again") - c("_later")).otherwise(0)).alias("fresh")).filter("n_grants > 0")


def grant_pairs(grants: DataFrame, pairs: DataFrame) -> DataFrame:
    """H1 for a table of (user_id, doc_id, granted_at) pairs of any size."""
    return latest(grants.unionByName(pairs.select(
        F.col("user_id").cast("string"), F.col("doc_id").cast("string"), "granted_at")))


def latest(grants: DataFrame) -> DataFrame:
    return grants.groupBy("user_id", "doc_id").agg(F.max("granted_at").alias("granted_at"))


def grant_admin(grants: DataFrame, users: DataFrame, at) -> DataFrame:
    """H2."""
    rows = users.select(F.col("user_id").cast("string"), F.lit(ADMIN).alias("doc_id"),
                        F.lit(at).cast("timestamp").alias("granted_at"))
    return latest(grants.unionByName(rows))


def revoke(grants: DataFrame, pairs: DataFrame) -> DataFrame:
    """H3: remove single pairs; a missing pair is fine."""
    return grants.join(pairs.select("user_id", "doc_id").distinct(), ["user_id", "doc_id"], "left_anti")


def revoke_document(grants: DataFrame, docs: DataFrame) -> DataFrame:
    """H4: remove every grant of the listed documents."""
    return grants.join(docs.select(F.col("doc_id").cast("string")).distinct(), "doc_id", "left_anti")


def accessible(grants: DataFrame, users: DataFrame) -> DataFrame:
    """H5: per user ``is_admin`` and the number of documents; unknown users have none.  No cap."""
    per_user = grants.groupBy("user_id").agg(
        F.bool_or(F.col("doc_id") == ADMIN).alias("is_admin"),
        F.count_distinct(F.when(F.col("doc_id") != ADMIN, F.col("doc_id"))).alias("n_docs"))
    return users.select("user_id").distinct().join(per_user, "user_id", "left").select(
        "user_id", F.coalesce("is_admin", F.lit(False)).alias("is_admin"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def admins(grants: DataFrame) -> DataFrame:
    return grants.filter(F.col("doc_id") == ADMIN).select("user_id").distinct()


def visible(rows: DataFrame, grants: DataFrame, user: str = "user_id", doc: str = "doc_id") -> DataFrame:
    """H6, F16: rows whose user may see their document; administrators see all of theirs."""
    pairs = grants.filter(F.col("doc_id") != ADMIN).select(
        F.col("user_id").alias(user), F.col("doc_id").alias("_doc")).distinct().withColumn("_ok", F.lit(True))
    flagged = rows.join(admins(grants).select(F.col("user_id").alias(user), F.lit(True).alias("_admin")), user, "left")
    keyed = flagged.withColumn("_doc", F.col(doc).cast("string"))
    return keyed.join(pairs, [user, "_doc"], "left").filter(
        F.coalesce("_admin", "_ok", F.lit(False))).select(*rows.columns)


@dataclass
class Visibility:
    """F16: what the asking users may see, by classes of users with equal grants.

    ``askers``: query_id, _class, _all (an administrator); ``documents``: _doc and _may, the classes that may see it.
    """
    askers: DataFrame
    documents: DataFrame

    def __post_init__(self):
        self._near = [broadcast_if_small(self.askers), broadcast_if_small(self.documents)]

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows by query_id with their user's class; rows of users who may see nothing are left out."""
        return rows.join(self._near[0], "query_id")

    def mark(self, rows: DataFrame, doc: str = "doc_id") -> DataFrame:
        """Rows by document with the classes that may see them."""
        return rows.withColumn("_doc", F.col(doc).cast("string")).join(
            self._near[1], "_doc", "left").drop("_doc")

    @staticmethod
    def allows() -> Column:
        """On rows that carry both: whether the user may see the document."""
        return F.col("_all") | F.coalesce(F.array_contains("_may", F.col("_class")), F.lit(False))


def visibility(questions: DataFrame, grants: DataFrame, user: str = "user_id") -> Visibility:
    """F16: asking users folded into classes of equal grant sets, named by their first user.

    A set is known by its size and two sums over SHA-256 digests of its documents, so a user with any number of grants
    is a partial aggregate.  A document is listed once with the classes that may see it, not once per user.
    """
    who = questions.select("query_id", F.col(user).cast("string").alias("user_id"))
    mine = grants.join(broadcast_if_small(who.select("user_id").distinct()), "user_id", "left_semi").select(
        "user_id", "doc_id").distinct()
    boss = mine.filter(F.col("doc_id") == ADMIN).select("user_id", F.lit(True).alias("_all"))
    some = store(mine.join(boss, "user_id", "left_anti"))
    part = lambda at: F.conv(F.substring(F.sha2("doc_id", 256), at, 15), 16, 10).cast("decimal(38,0)")
    signed = some.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    named = signed.groupBy("n", "a", "b").agg(F.concat(F.lit("of "), F.min("user_id")).alias("_class"))
    classes = signed.join(named, ["n", "a", "b"]).select("user_id", "_class", F.lit(False).alias("_all"))
    askers = who.join(classes.unionByName(boss.withColumn("_class", F.lit(EVERYTHING))), "user_id").select(
        "query_id", "_class", "_all")
    documents = some.withColumn("_class", F.concat(F.lit("of "), "user_id")).join(named.select("_class"), "_class").groupBy(
        F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set("_class")).alias("_may"))
    return Visibility(store(askers), store(documents))


def visible_documents(docs: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """H6 for a document list: (user_id, doc_id) each asking user can open.

    An administrator is one row with ``*``: listing every document for every administrator would
    multiply the corpus.
    """
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    mine = grants.join(users.select("user_id").distinct(), "user_id", "left_semi")
    some = mine.join(admins(grants), "user_id", "left_anti").join(ids, "doc_id", "left_semi")
    return some.select("user_id", "doc_id").unionByName(
        mine.filter(F.col("doc_id") == ADMIN).select("user_id", "doc_id")).distinct()


def require_user(questions: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """H7: (accepted, rejected) questions; a blank user is rejected."""
    named = F.coalesce(F.trim(F.col(user)), F.lit("")) != ""
    return questions.filter(named), questions.filter(~named).withColumn("reason", F.lit("user_id is required"))
