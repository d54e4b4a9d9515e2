"""Stream jobs: ingest, thread state, answer-cache keys and usage totals.

Event time is ``ts`` with a declared watermark.  Every job takes a checkpoint location in shared
storage, so it restarts after a lost driver or executor.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.conversation import THREAD, answer_key
from lectern.operators.sections import sectionize_text
from lectern.plans.common import broadcast_if_small
from lectern.sources.messages import accepted, dead_letters

STATE = "message_count long, first_asked long, title string, last_seq long, last_content string"
OUTPUT = f"thread_id string, since long, closed boolean, {STATE}"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ThreadState(StatefulProcessor):
    """Six scalars per thread, whatever its length, dropped when the thread has been quiet for ``idle_ms`` of event time.

    The title comes with the least ``seq`` of a user's message and the last text with the greatest ``seq``, so the order
    of arrival does not matter.  ``since`` is the watermark at which the state began: a thread that speaks again after
    its state was dropped starts a new one, whose watermark is later, and `merged_threads` puts the parts together.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("thread", f"since long, seen long, {STATE}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        since, seen, count, asked, title, last, text = self.value.get() if self.value.exists() else (
            now, 0, 0, None, None, None, None)
        for pdf in rows:
            count += len(pdf)
            seen = max(seen, int(pdf["at"].max()))
            users = pdf[(pdf["role"] == "user") & pdf["seq"].notna()]
            if len(users):
                first = users.loc[users["seq"].idxmin()]
                if asked is None or first["seq"] < asked:
                    asked, title = int(first["seq"]), first["content"]
            placed = pdf[pdf["seq"].notna()]
            if len(placed):
                newest = placed.loc[placed["seq"].idxmax()]
                if last is None or newest["seq"] > last:
                    last, text = int(newest["seq"]), newest["content"]
        self.value.update((since, seen, count, asked, title, last, text))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(seen, now) + self.idle_ms)
        yield self._row(key, since, False, count, asked, title, last, text)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, _, *state = self.value.get()
        self.value.clear()
        yield self._row(key, since, True, *state)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, *values) -> pd.DataFrame:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        return pd.DataFrame([(key[0], *values)], columns=names).astype({n: "Int64" for n in ("first_asked", "last_seq")})


def thread_state_stream(messages: DataFrame, watermark: str = "1 hour", idle: str = "1 hour") -> DataFrame:
    """State per thread, updated by each micro-batch and dropped after ``idle`` without a message.

    Messages come in any order within the watermark; later ones are dropped by the watermark, as anywhere in a stream
    (times of 1970 and before count as late from the start).  Rows without time are left out, a null seq counts as a message but is neither first nor last.
    Messages themselves are appended to a table.  State lives in RocksDB, as it may be larger than memory;
    the session's state store is set to it.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    idle_ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {idle})").first()[0]
    timed = messages.filter("ts IS NOT NULL").withWatermark("ts", watermark).select(
        F.col(THREAD).cast("string"), F.col("seq").cast("long"), "role", "content", "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy(THREAD).transformWithStateInPandas(ThreadState(idle_ms), OUTPUT, "Update", "EventTime")


def merged_threads(updates: DataFrame, epoch: str = "epoch") -> DataFrame:
    """One row per thread from the updates of `thread_state_stream`: the last update of each part, then all parts together.

    Both steps are partial aggregates.
    """
    state = [c.split()[0] for c in STATE.split(", ")]
    parts = updates.groupBy(THREAD, "since").agg(F.max_by(F.struct(*state), F.struct(epoch, "closed")).alias("s")).select(THREAD, "s.*")
    return parts.groupBy(THREAD).agg(
        F.sum("message_count").alias("message_count"), F.max("last_seq").alias("last_seq"),
        F.min_by("title", "first_asked").alias("title"), F.max_by("last_content", "last_seq").alias("last_content"))


def first_questions(log: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Questions the cache cannot answer yet: one per key within the lifetime."""
    keyed = log.filter(~F.col("context_dependent")).withColumn("key", answer_key(
        F.col("question"), F.col("active_docs")))
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def usage_totals_stream(costed: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """I16: calls, tokens and cost per model and event-time window."""
    return costed.withWatermark("ts", watermark).groupBy(F.window("ts", window), "model_name").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_cost_usd").alias("total_cost_usd"))


def ingest_stream(parsed: DataFrame, out: str, checkpoint: str, cut: Callable[[DataFrame], DataFrame] = sectionize_text,
                  version: str = "sent_at"):
    """Documents, sections, dead letters and a manifest under ``out``, each message once.

    Every micro-batch is read and parsed once: it is written to its own folder, and its documents, sections
    and dead letters are derived from what was written.  The folder is named by the stream and the epoch, so
    a repeated epoch writes over itself, and the row of the manifest comes last: `ingested` reads only epochs that
    have one, so a batch that broke off is not seen.  Two streams may write to one ``out``.
    Of one path's messages in a batch the one with the greatest ``version`` stays (then the greatest text).
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        place = f"stream={stream}/epoch={epoch}"
        if _written(spark, f"{out}/manifest/{place}"):
            return
        batch.write.mode("overwrite").parquet(f"{out}/messages/{place}")
        got = spark.read.schema(batch.schema).parquet(f"{out}/messages/{place}")
        accepted(got).withColumn("doc_id", F.sha2("source_path", 256)).groupBy("doc_id").agg(F.max_by(
            F.struct("source_path", "domain", "text", F.col(version).alias("version")), F.struct(version, "text")).alias("d")).select(
            "doc_id", "d.*").write.mode("overwrite").parquet(f"{out}/documents/{place}")
        docs = spark.read.parquet(f"{out}/documents/{place}")
        cut(docs).write.mode("overwrite").parquet(f"{out}/sections/{place}")
        dead_letters(got).write.mode("overwrite").parquet(f"{out}/dead/{place}")
        got.agg(F.count("*").alias("messages"), F.count("error").alias("dead")).write.mode("overwrite").parquet(
            f"{out}/manifest/{place}")
    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def _written(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:                            # no such folder, or one that broke off before its first file
        return False


def ingested(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of `ingest_stream` in the epochs of the manifest; of documents and sections only each path's newest version.

    ``table``: documents, sections, dead, messages or manifest.  A message that comes late with an older version changes
    nothing, one that comes again adds nothing.
    """
    manifest = spark.read.parquet(f"{out}/manifest")
    if table == "manifest":
        return manifest
    done = broadcast_if_small(manifest.select("stream", "epoch"))

    def read(name):
        return spark.read.parquet(f"{out}/{name}").join(done, ["stream", "epoch"], "left_semi")
    if table in ("dead", "messages"):
        return read(table)
    newest = read("documents").groupBy("doc_id").agg(F.max_by(
        F.struct("stream", "epoch"), F.struct("version", "text", "stream", "epoch")).alias("k")).select("doc_id", "k.*")
    return read(table).join(newest, ["doc_id", "stream", "epoch"], "left_semi")
