"""Conversation threads from a table of messages (thread_id, seq, role, content[, ts]).

Windows are keyed by thread.  Values that need only an extreme of a thread (first question, last
message, counts) are partial aggregates, so one very long thread does not become one task's sort.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.hof import STRINGS
from lectern.functions.text import (collapse, compact_message, fold_case, label, parse_profile, path_key,
                                    profile_is_empty, strip, truncate)
from lectern.plans.common import store

THREAD = "thread_id"


def last_before(df: DataFrame, key: str, order: str, value: Column, name: str, block: int = 4096) -> DataFrame:
    """Last non-null ``value`` of the same key before each row.

    Each key is cut into blocks of ``order``: a window inside the block plus the carry of earlier
    blocks (one row per block), so one huge key spreads over many tasks.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(order) / block)).withColumn("_v", value)
    inside = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.filter(F.col("_v").isNotNull()).groupBy(key, "_blk").agg(F.max_by("_v", order).alias("_end"))
    steps = blocked.select(key, "_blk").distinct().join(ends, [key, "_blk"], "left")
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.withColumn("_carry", F.last("_end", True).over(earlier)).select(key, "_blk", "_carry")
    return blocked.withColumn("_in", F.last("_v", True).over(inside)).join(carry, [key, "_blk"]).withColumn(
        name, F.coalesce("_in", "_carry")).drop("_blk", "_v", "_in", "_carry")


def ordered_fold(df: DataFrame, keys: list[str], order: str | list[str], inputs: list[str], step, schema: str
                 ) -> DataFrame:
    """Fold the rows of each key in order: ``step(state, *inputs) -> (state, outputs)``.

    Spark partitions and sorts (spilling to disk); the Python side keeps one state, never a group.
    """
    order = [order] if isinstance(order, str) else order
    from_schema = df.schema
    out_type = T.StructType([*from_schema.fields, *T.StructType.fromDDL(schema).fields])
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches):
        last, state = None, None
        for pdf in batches:
            results = []
            for key, args in zip(pdf[keys].itertuples(index=False, name=None),
                                 pdf[inputs].itertuples(index=False, name=None)):
                if key != last:
                    last, state = key, None
                state, out = step(state, *args)
                results.append(out)
            for n, name in enumerate(names):
                pdf[name] = [r[n] for r in results]
            yield pdf
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out_type)


def thread_state(messages: DataFrame) -> DataFrame:
    """Per thread the message count, title from the first user message and the last message."""
    user = F.col("role") == "user"
    return messages.groupBy(THREAD).agg(
        F.count("*").alias("message_count"), F.max("seq").alias("last_seq"),
        F.max_by("role", "seq").alias("last_role"), F.max_by("content", "seq").alias("last_content"),
        label(F.coalesce(F.min_by(F.when(user, F.col("content")), F.when(user, F.col("seq"))), F.lit("")))
        .alias("title"))


def recent_messages(messages: DataFrame, n: int = 6, compact: bool = True) -> DataFrame:
    """The last ``n`` messages of each thread; none when ``n`` is 0.

    Ranking before collecting lets Spark cut each thread to ``n`` rows before the shuffle.
    """
    w = Window.partitionBy(THREAD).orderBy(F.desc("seq"))
    last = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    return last.withColumn("content", F.when(F.col("role") == "assistant", compact_message(
        F.col("content"))).otherwise(F.col("content"))) if compact else last


def previous_pair(messages: DataFrame) -> DataFrame:
    """For every message the last answer before it and the question before that answer."""
    asked = last_before(messages, THREAD, "seq", F.when(F.col("role") == "user", F.col("content")), "_q")
    said = F.when(F.col("role") == "assistant", F.struct(
        F.col("content").alias("a"), F.coalesce("_q", F.lit("")).alias("q")))
    return last_before(asked, THREAD, "seq", said, "_p").withColumn(
        "previous_answer", F.coalesce("_p.a", F.lit(""))).withColumn(
        "previous_question", F.coalesce("_p.q", F.lit(""))).drop("_q", "_p")


def current_topic(topics: Column, question: Column) -> Column:
    """I4: topic label of a thread: the topic hints, else the question, cut at 90."""
    return label(F.when(F.size(topics) > 0, F.array_join(topics, ", ")).otherwise(question), 90)


def list_threads(threads: DataFrame, user: str = "user_id", limit: int = 20) -> DataFrame:
    """Per user the newest ``limit`` threads."""
    w = Window.partitionBy(user).orderBy(F.desc("updated_at"), THREAD)
    return threads.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def thread_summary(messages: DataFrame) -> DataFrame:
    """Message count and a 96-character preview of the last message."""
    return messages.groupBy(THREAD).agg(
        F.count("*").alias("message_count"),
        truncate(F.max_by("content", "seq"), 96).alias("preview"))


def summary_due(messages: DataFrame, window: int = 6, trigger: int = 8) -> DataFrame:
    """The trim to ``window`` comes first, so nothing is due while ``window`` < ``trigger``."""
    return messages.groupBy(THREAD).agg((F.least(F.count("*"), F.lit(window)) >= trigger).alias("summary_due"))


def after_reset(messages: DataFrame, is_reset: Column) -> DataFrame:
    """I8: messages after the last reset marker of their thread; a thread keeps its id.

    The last reset is a partial aggregate joined back, not a window over the whole thread.
    """
    last = messages.filter(is_reset).groupBy(THREAD).agg(F.max("seq").alias("_r"))
    return messages.join(last, THREAD, "left").filter(F.col("seq") > F.coalesce("_r", F.lit(-1))).drop("_r")


def resume_questions(user_turns: DataFrame) -> DataFrame:
    """Pending-clarification state per thread, one row per user turn with its effective question.

    Input columns: thread_id, seq, content, ask_profile, ask_question (the rules of the question
    analysis).  A profile reply that names nothing keeps the question pending; a general reply is
    appended to the pending question.  A resumed question is not put back to the same clarification.
    """
    turns = user_turns.select(
        THREAD, "seq", strip(F.col("content")).alias("text"), F.col("ask_profile").alias("p"),
        F.col("ask_question").alias("q"), (~profile_is_empty(parse_profile(F.col("content")))).alias("named"))

    def step(state, text, p, q, named):
        kind, pending, known = state or ("", "", False)
        if kind == "profile" and not named:
            return ("profile", pending, known), (pending or text, "retry_profile")
        if kind == "profile":
            return ("", "", True), (pending or text, "resumed")
        if kind == "question":
            return ("", "", known), (" ".join(x for x in (pending.strip(), text) if x), "resumed")
        if p and not known:
            return ("profile", text, known), (text, "ask_profile")
        if q:
            return ("question", text, known), (text, "ask_question")
        return ("", "", known), (text, "search")
    return ordered_fold(turns, [THREAD], "seq", ["text", "p", "q", "named"], step,
                        "effective_question string, outcome string").select(
        THREAD, "seq", "effective_question", "outcome")


def carry_active(answers: DataFrame, *columns: str) -> DataFrame:
    """Documents and sections of the previous answer of the thread."""
    out = last_before(answers, THREAD, "seq", F.struct(*columns), "_a")
    for c in columns:
        out = out.withColumn("active_" + c, F.coalesce("_a." + c, F.array().cast(STRINGS)))
    return out.drop("_a")


def unique_sources(sources: DataFrame, path: str = "source_path") -> DataFrame:
    """First source per thread and path key."""
    return sources.withColumn("path_key", path_key(F.col(path))).filter(F.col("path_key") != "").groupBy(
        THREAD, "path_key").agg(F.min_by(F.struct("rank", path), "rank").alias("s")).select(
        THREAD, "path_key", "s.*")


def answer_key(question: Column, active_docs: Column) -> Column:
    """Cache key of a question and its active documents."""
    return F.substring(F.sha2(F.concat(fold_case(collapse(question)), F.lit("\x00"), F.array_join(
        F.sort_array(active_docs), "\x01")), 256), 1, 24)


NEVER, ALWAYS = -(1 << 62), (1 << 62)


def _stored_by_block(rows: DataFrame, ttl: int) -> DataFrame:
    """Each block of a key (named by its first microsecond) as a function: from the time an entry was stored before it to the time one is stored after it.

    A block is a step function with one row per step: an entry of time at most ``upto`` (and above the step before)
    leaves ``stored``.  Every block has a last step with ``upto`` = ALWAYS, so none is without rows.  Entries are alive
    for ``ttl`` and a block is longer, so an entry that no time of the block replaces has died at its end.
    The steps are the distinct storing times of the block's first lifetime, fewer where their ways meet later; a step's
    way through the block is one sorted search a lifetime for all steps together.
    """
    def through(upto, stored, times):
        """The steps after more storing times (sorted), ways that have met made one."""
        while len(times):
            at = np.searchsorted(times, stored + ttl, "right")
            again = at < len(times)
            if not again.any():
                break
            stored = np.where(again, times[np.minimum(at, len(times) - 1)], stored)
            last = np.append(stored[1:] != stored[:-1], True)
            upto, stored = upto[last], stored[last]
        return upto, stored

    def run(batches):
        key, upto, stored = None, None, None

        def steps(closed):
            if len(closed[0]) and closed[0][-1] == ALWAYS:
                u, s = closed
            else:
                u, s = np.append(closed[0], ALWAYS), np.append(closed[1], NEVER)
            for at in range(0, len(u), 65536):
                some = slice(at, at + 65536)
                yield pd.DataFrame({"key": key[0], "block": key[1], "upto": u[some], "stored": s[some]})
        none = np.zeros(0, np.int64)
        for pdf in batches:
            for (k, b), part in pdf.groupby(["key", "block"], sort=False):
                if (k, b) != key:
                    if key is not None:
                        yield from steps((upto, stored))
                    key, upto, stored = (k, b), none, none
                times = np.unique(part["t"].to_numpy()[part["ok"].to_numpy(bool)])
                first = times[times < b + ttl]                  # entries of earlier blocks may still be alive
                fresh = first if not len(stored) else first[first > stored[-1]]
                upto, stored = np.append(upto, fresh - ttl - 1), np.append(stored, fresh)
                later = times[len(first):]
                if len(later) and not (len(upto) and upto[-1] == ALWAYS):   # all entries of earlier blocks are dead here
                    upto, stored = np.append(upto, ALWAYS), np.append(stored, later[0])
                upto, stored = through(upto, stored, later)
        if key is not None:
            yield from steps((upto, stored))
    return rows.select("key", "block", "t", "ok").repartition("key", "block").sortWithinPartitions(
        "key", "block", "t").mapInPandas(run, "key string, block long, upto long, stored long")


def _entry_of_block(functions: DataFrame) -> DataFrame:
    """Scan of the blocks' functions in the order of each key: the entry that every block starts with."""
    def run(batches):
        key = block = entry = None
        after = NEVER
        for pdf in batches:
            keys, blocks, starts = [], [], []
            for (k, b), part in pdf.groupby(["key", "block"], sort=False):
                if (k, b) != (key, block):
                    entry = NEVER if k != key else after
                    key, block, open_ = k, b, True
                    keys.append(k), blocks.append(b), starts.append(entry)
                at = int(np.searchsorted(part["upto"].to_numpy(), entry, "left"))
                if open_ and at < len(part):                     # a block's steps may go over several batches
                    after, open_ = int(part["stored"].iloc[at]), False
            if keys:
                yield pd.DataFrame({"key": keys, "block": blocks, "entry": starts})
    return functions.repartition("key").sortWithinPartitions("key", "block", "upto").mapInPandas(
        run, "key string, block long, entry long")


def _hits(rows: DataFrame, ttl: int) -> DataFrame:
    """Rows of blocks with their entry, in order: one sorted search for each entry stored, not for each row."""
    def run(batches):
        key, entry = None, NEVER
        for pdf in batches:
            found = []
            for (k, b), part in pdf.groupby(["key", "block"], sort=False):
                if (k, b) != key:
                    key, entry = (k, b), int(part["entry"].iloc[0])
                t, ok = part["t"].to_numpy(), np.flatnonzero(part["ok"].to_numpy(bool))
                hit, at = np.zeros(len(t), bool), 0
                while at < len(t):
                    end = max(at, int(np.searchsorted(t, entry + ttl, "right")))
                    hit[at:end] = True
                    store = np.searchsorted(ok, end)
                    if end == len(t) or store == len(ok):
                        break
                    entry, at = int(t[ok[store]]), int(ok[store]) + 1
                found.append(hit)
            yield pd.DataFrame({"key": pdf["key"], "query_id": pdf["query_id"], "hit": np.concatenate(found)
                                if found else np.zeros(0, bool)})
    kind = rows.schema["query_id"].dataType.simpleString()
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "t", "query_id").mapInPandas(
        run, f"key string, query_id {kind}, hit boolean")


def answer_cache(log: DataFrame, ttl_seconds: int = 3600, context: str = "context_dependent",
                 answerable: str = "answerable", lifetimes: int = 64) -> DataFrame:
    """Which questions of a log the cache answers.

    An entry lives ``ttl_seconds`` from the miss that stored it; hits do not renew it.  Follow-ups
    bypass the cache and unanswered questions store nothing; rows without time are left out, a null
    question counts as empty.

    The log of a key is cut into time blocks of ``lifetimes`` lifetimes (two at least).  A block is a function from the entry it
    starts with to the entry it ends with, found for all blocks at once; a scan over these functions
    gives each block its entry, and then all blocks are answered at once.  So a question asked all
    year spreads over as many tasks as it has blocks, and the scan of a key reads at most the
    storing times of one lifetime in ``lifetimes``.
    """
    if lifetimes < 2:
        raise ValueError("a block has two lifetimes at least")
    ttl = ttl_seconds * 1_000_000
    width = ttl * lifetimes
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    usable = log.filter(~F.col(context)).select(
        "query_id", answer_key(F.col("question"), F.col("active_docs")).alias("key"), t.alias("t"),
        F.coalesce(F.col(answerable), F.lit(False)).alias("ok"), (t - F.pmod(t, F.lit(width))).alias("block")).dropna(subset=["t"])
    rows = store(usable)
    entries = _entry_of_block(_stored_by_block(rows, ttl))
    return _hits(rows.join(entries, ["key", "block"]), ttl)


def expire(cache: DataFrame, now, prefix: str = "") -> DataFrame:
    """Entries that are still alive; with a prefix, keys of that prefix are cleared too."""
    alive = cache.filter(F.col("expires_at") >= F.lit(now).cast("timestamp"))
    return alive.filter(~F.col("key").startswith(prefix)) if prefix else alive


def source_images(sources: DataFrame, sections: DataFrame, path: str = "source_path") -> DataFrame:
    """All images of the sections with the source's path key, one row each with its place: (order_index, pos).

    Rows are kept as rows, as a path may have any number of images; a source without images has none.
    """
    images = sections.select(path_key(F.col(path)).alias("_k"), "order_index", F.posexplode("images").alias("pos", "image"))
    return sources.withColumn("_k", path_key(F.col(path))).join(images, "_k").drop("_k")
