"""Shared pieces of search plans: stored tables, checked broadcasts, ranking, skew-safe term joins."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.hof import let

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is named, a temporary one is set if driver and executors are one process; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that goes when the session ends."""
    path = f"{shared_dir(spark)}/lectern/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write a table that several parts of a plan read, and read it back.

    The written table has real size statistics, is pruned by column, outlives any executor, and goes when the session
    ends.
    """
    path = session_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, by: str, buckets: int, dealt: bool = False) -> DataFrame:
    """As `store`, one file for each hash bucket of a column: later grouping on that column needs no shuffle.

    The bucket of a row is pmod(hash(column), buckets).  ``dealt``: the rows are already repartitioned so.
    """
    spark = df.sparkSession
    table = f"lectern_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lectern/{table}"
    (df if dealt else df.repartition(buckets, by)).write.bucketBy(buckets, by).option("path", path).saveAsTable(table)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(table)


def drop_bucketed(df: DataFrame) -> None:
    """Delete a table of `store_bucketed` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        spark.sql(f"DROP TABLE {place.getName()}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Checked size: at most ``max_rows`` rows (counting stops one row later) and ``max_bytes`` of values."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        size = size + F.coalesce(F.octet_length(f.name) if kind in ("string", "binary") else F.octet_length(
            F.to_json(F.struct(f.name))) if kind in ("array", "map", "struct") else F.lit(8), F.lit(0))
    n, total = df.limit(max_rows + 1).select(size.alias("_b")).agg(F.count("*"), F.sum("_b")).first()
    return n <= max_rows and (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def top_k(df: DataFrame, k: int, by: str | Sequence[str] = "query_id", score: str = "score",
          tie: str | Sequence[str] = "section_id", rank: str = "rank") -> DataFrame:
    """First ``k`` per key by score, ties by key columns.

    Planned as a window group limit: each task keeps ``k`` rows per key before the shuffle.
    """
    by = [by] if isinstance(by, str) else list(by)
    tie = [tie] if isinstance(tie, str) else list(tie)
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def term_join(postings: DataFrame, wanted: DataFrame, on: Sequence[str], spread: str,
              max_broadcast: int = BROADCAST_ROWS, hot_rows: int | None = None, small: bool | None = None) -> DataFrame:
    """Join postings to the wanted terms of all questions.

    A small (checked) question side is broadcast: postings are read once and not shuffled.  Beyond
    that, postings of hot keys are spread over salts by a hash of ``spread`` and the question rows
    of those keys are repeated per salt, so no key is one task.  The hot list holds at most
    total / hot_rows keys by construction.  ``small``: the answer of that check where the caller has it.
    """
    if is_small(wanted, max_broadcast) if small is None else small:
        return postings.join(F.broadcast(wanted), list(on))
    keys = wanted.select(*on).distinct()
    used = postings.join(keys, list(on), "left_semi")
    counts = used.groupBy(*on).count()
    limit = hot_rows or max(1_000_000, postings.count() // 10_000)
    hot = F.broadcast(counts.filter(F.col("count") > limit).select(
        *on, F.ceil(F.col("count") / limit).cast("int").alias("_salts")))
    left = used.join(hot, list(on), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    right = wanted.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(
        F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).withColumn("_salt", F.col("_salt").cast("long")).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


GRAM_SIZES = (1, 2, 3, 8, 24)


def grams(text: Column, sizes: Sequence[int] = GRAM_SIZES) -> Column:
    """Distinct character grams of a text."""
    def of(chars):
        n = F.size(chars)
        some = lambda s: F.when(n >= s, F.transform(F.sequence(F.lit(1), F.greatest(n - (s - 1), F.lit(1))),
                                                    lambda i: F.array_join(F.slice(chars, i, s), ""))).otherwise(
            F.array().cast("array<string>"))
        return F.array_distinct(F.concat(*[some(s) for s in sizes]))
    return let(F.split(text, ""), of)


PHRASES, PHRASE_BYTES = 200_000, 4 << 20               # an automaton takes some 50 bytes a byte of its phrases


def phrases_in(texts: DataFrame, key: str, text: str, phrases: list[str], phrase: str) -> DataFrame:
    """(``key``, ``phrase``) for each row's text and each of the phrases in it, once: one pass over the texts.

    The phrases (a size the caller has checked) are broadcast; a task makes one automaton of them.  What a text costs
    depends on its length and its matches alone, not on how many phrases there are.
    """
    given = texts.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n, p in enumerate(given.value):
            automaton.add_word(p, n)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({n for _, n in automaton.iter(t)}) if t else [] for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, ns in enumerate(found) for _ in ns], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(
                [given.value[n] for ns in found for n in ns], pa.string())], [key, phrase])
    schema = T.StructType([texts.schema[key], T.StructField(phrase, T.StringType())])
    return texts.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def substring_join(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str,
                   max_phrases: int = PHRASES, max_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Pairs (``key``, phrase columns) where the phrase is a substring of the text.

    Phrases of a checked size go to the tasks as one automaton and the texts are read once; only matches travel.
    More phrases than that meet the texts by grams (`gram_join`).  Empty and null phrases and texts give no pairs.
    """
    own = phrases.filter(F.col(phrase) != "")
    distinct = own.select(phrase).distinct()
    if not is_small(distinct, max_phrases, max_bytes):
        return gram_join(texts, key, text, phrases, phrase)
    known = [r[0] for r in distinct.collect()]                       # at most max_phrases and max_bytes
    if not known:
        return texts.select(key).join(phrases, F.lit(False))
    found = phrases_in(texts, key, text, known, phrase)
    small = is_small(own)
    return term_join(found if small else store(found), own, [phrase], key, small=small).select(key, *phrases.columns)


def gram_join(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """`substring_join` as an equi-join, for any number of phrases.

    A phrase is keyed by its head of the longest gram size it reaches; a text gives its distinct
    grams of the sizes in use.  Only keys and grams travel; candidates are verified on the text.
    """
    size = F.lit(None).cast("int")
    for s in GRAM_SIZES:
        size = F.when(F.length(phrase) >= s, s).otherwise(size)
    keyed = phrases.filter(F.col(phrase) != "").withColumn("_s", size).withColumn(
        "_g", F.substring(F.col(phrase), F.lit(1), F.col("_s")))
    sizes = sorted(r[0] for r in keyed.select("_s").distinct().collect())     # at most five numbers
    if not sizes:
        return texts.select(key).join(phrases, F.lit(False))
    some = texts.select(key, F.explode(grams(F.col(text), sizes)).alias("_g"))
    pairs = some.join(keyed.drop("_s"), "_g").drop("_g")
    return pairs.join(texts.select(key, F.col(text).alias("_t")), key).filter(F.col("_t").contains(F.col(phrase))).drop("_t")
