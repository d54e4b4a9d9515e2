"""Repeated byte strings: anchored stretches, suffix arrays of shards by induced sorting, permuted common prefixes."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mix, pieces, prefix_sums, span_hash

GRAM = 32
PIECE = 2 << 20
POSITION = np.uint64((1 << 28) - 1)


def dense_rank(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row by the keys, first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_reduced(name: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a reduced string, recursively on pairs of names, to `depth` symbols at least."""
    if depth <= 1 or len(name) < 2 or name.max() == len(name) - 1:
        return name
    step, width = name, 1
    while width < depth and step.max() < len(step) - 1:
        after = np.full(len(step), -1, np.int64)
        after[:-width] = step[width:]
        step = dense_rank(step, after)
        width *= 2
        if width >= len(step):
            break
    return step


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by induced sorting, in order of the first `depth` symbols at least.

    t ends with its only 0.  Suffixes are classified (smaller or larger than the next); leftmost smaller ones are
    named by their substrings and the reduced string is sorted; larger ones are induced from them bucket by bucket in
    ascending order, smaller ones in descending order.  A bucket's pushes are done for whole arrays, so the
    work is linear, with one step for each symbol and run.
    """
    n = len(t)
    t = t.astype(np.int64)
    change = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.searchsorted(change, np.arange(n - 1))
    smaller = np.ones(n, bool)
    smaller[:-1] = t[change[nxt]] < t[change[nxt] + 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # names of the substrings from one leftmost smaller suffix to the next: six (symbol, class) pairs to a key
    code = np.concatenate([2 * t + smaller + 1, np.zeros(8, np.int64)]).astype(np.uint64)
    end = np.concatenate([lms[1:], [n - 1]])
    name, at, left = np.zeros(len(lms), np.int64), lms.copy(), np.arange(len(lms))
    keys = []
    longest = int((end - lms).max()) + 1 if len(lms) else 0
    for lo in range(0, longest, 6):
        key = np.zeros(len(lms), np.uint64)
        live = np.flatnonzero(lms + lo <= end)
        for k in range(6):
            p = lms[live] + lo + k
            key[live] = (key[live] << np.uint64(10)) | np.where(p <= end[live], code[np.minimum(p, n + 7)], 0)
        keys.append(key)
        if len(keys) == 4:
            keys = [dense_rank(*keys).astype(np.uint64)]
    if keys:
        name = dense_rank(*keys)
    lms = lms[np.argsort(sort_reduced(name, depth // 2 + 2), kind="stable")]

    size = int(t.max()) + 1
    starts = np.searchsorted(t[lms], np.arange(size + 1)) if len(lms) else np.zeros(size + 1, np.int64)

    def induce(symbols, seeds, wanted: np.ndarray):
        """Per symbol the induced suffixes in order of their arrival; seeds(c) are sorted sources besides them."""
        queue: list[list[np.ndarray]] = [[] for _ in range(size)]
        done: list[np.ndarray] = [np.empty(0, np.int64)] * size

        def push(source: np.ndarray, own: int) -> np.ndarray:
            before = source[source > 0] - 1
            before = before[wanted[before]]
            symbol = t[before]
            same = before[symbol == own]
            other = symbol != own
            before, symbol = before[other], symbol[other]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
            for part in np.split(before, cut) if len(before) else ():
                queue[t[part[0]]].append(part)
            return same

        for c in symbols:
            parts = queue[c]
            now = np.concatenate(parts) if parts else np.empty(0, np.int64)
            got = []
            while len(now):
                got.append(now)
                now = push(now, c)
            done[c] = np.concatenate(got) if got else done[c]
            push(seeds(c), -1)
        return done

    larger = induce(range(size), lambda c: lms[starts[c]:starts[c + 1]], ~smaller)
    tails = induce(range(size - 1, -1, -1), lambda c: larger[c][::-1], smaller)
    tails[0] = np.array([n - 1])
    return np.concatenate([x for c in range(size) for x in (larger[c], tails[c][::-1])])


def repeated_windows(t: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the window starts (ascending) begin a string of `length` symbols that another position begins too.

    The common prefix with the suffix array's predecessor is written in text order (permuted) and read for both.
    """
    sa = suffix_array(t, length)
    prev = np.full(len(t), -1, np.int64)
    prev[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint64), np.zeros(length + 4, np.uint64)])
    four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
    i = starts[prev[starts] >= 0]
    j = prev[i]
    for d in [*range(0, length - 3, 4), length - 4]:
        alike = four[i + d] == four[j + d]
        i, j = i[alike], j[alike]
    twice = np.zeros(len(t), bool)
    twice[i] = twice[j] = True
    return twice[starts]


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with the same anchor: row, first and last window start, anchor key, key of the whole stretch.

    A window's anchor is its gram with the smallest hash, the leftmost of equal ones, so equal windows have the same
    gram at the same place in them.
    """
    grams, span = len(data) - GRAM + 1, length - GRAM + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    sums = prefix_sums(data)
    at = np.arange(grams)
    value = span_hash(sums, at, at + GRAM)
    packed = (value & ~POSITION) | at.astype(np.uint64)
    full = -(-grams // span) * span
    blocks = np.concatenate([packed, np.full(full - grams, np.uint64((1 << 64) - 1))]).reshape(-1, span)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    start = np.arange(len(data) - length + 1)
    best = np.minimum(left[start], right[start + span - 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(start)]
    inside = start + length <= offsets[1:][row]
    start, row, anchor = start[inside], row[inside], (best[inside] & POSITION).astype(np.int64)
    if not len(start):
        return none, none, none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1]
    key = span_hash(sums, lo, hi + length) ^ mix((anchor[first] - lo).astype(np.uint64))
    return row[first], lo, hi, value[anchor[first]].view(np.int64), mix(key).view(np.int64)


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode()


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200, shard_bytes: int = 2 << 20,
                   shard_rows: int = 4096, kept_bytes: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Per row: its bytes, bytes removed, maximal removed runs, and a digest of what is kept (`kept_bytes`: that, too).

    A byte is removed if a string of `length` bytes over it also starts anywhere else, in the same text or another.
    Texts are cut into stretches of windows with the same anchor.  Stretches with the same key are copies; where one
    anchor has different stretches, one of each goes to a shard, whose suffix array and permuted common prefixes
    tell the windows that occur twice.  Shards have about `shard_bytes`; an anchor with more than `shard_rows`
    different stretches is cut into blocks, and every pair of blocks is a shard.  Anchors in one place are left out:
    their windows cannot occur elsewhere.

    Nulls count as empty texts.  Rows are told apart by id and a 64-bit hash of the text, and joined by both, so rows
    that repeat an id or have a null id are rows of their own and meet no others' texts, and identical rows remove each other.  An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    docs = df.select(df[id].alias("doc_id"), df[text].alias("text"), F.xxhash64(df[text]).alias("copy"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in pieces(batches, limit=PIECE):
            row, lo, hi, anchor, key = stretches(data, offsets, length)
            base = offsets[row]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(row)), piece.column("copy").take(pa.array(row)),
                 pa.array(lo - base), pa.array(hi - base), pa.array(anchor), pa.array(key)],
                ["doc_id", "copy", "lo", "hi", "anchor", "key"])

    # (doc_id, hash of the text) names a row; rows equal in both have equal stretches, and are counted as copies
    runs = scratch.store(docs.mapInArrow(
        cut, f"doc_id {kind}, copy bigint, lo bigint, hi bigint, anchor bigint, key bigint"))
    place = F.struct("doc_id", "copy", "lo", "hi")
    classes = scratch.store(runs.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.min(place).alias("p")))
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    several = scratch.store(classes.join(mixed, "anchor").select("anchor", "key", "n", "m", "p.*"))
    size = several.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))

    per_doc = several.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "key", "n", "m", "lo", "hi")).alias("own"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, _ in pieces(batches, limit=PIECE):
            rows = []
            for value, own in zip(piece.column("text").to_pylist(), piece.column("own").to_pylist()):
                data = bytes_of(value)
                rows += [(r["anchor"], r["key"], r["n"], r["m"], data[r["lo"]:r["hi"] + length]) for r in own]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(
                list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["anchor", "key", "n", "m", "bytes"])

    def same_row(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other["_id"]) & (docs["copy"] == other["_copy"])

    renamed = {"doc_id": "_id", "copy": "_copy"}
    per_doc = per_doc.withColumnsRenamed(renamed)
    loaded = docs.join(per_doc, same_row(per_doc)).select("text", "own").mapInArrow(
        load, "anchor bigint, key bigint, n bigint, m bigint, bytes binary")
    blocks = F.ceil(F.col("m") / shard_rows).cast("int")
    mine = F.pmod("key", blocks).cast("int")
    shard = F.when(blocks > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    placed = loaded.withColumn("z", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        (blocks > 1).alias("hot"), shard.alias("shard"), F.least(mine, "z").alias("x"), F.greatest(mine, "z").alias("y"),
        "anchor", "key", "n", "bytes")

    def compare(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        _, once = np.unique(key, return_index=True)
        table = table.take(pa.array(once))
        strings, n = table.column("bytes").to_pylist(), table.column("n").to_numpy()
        sizes = np.array([len(s) for s in strings])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        t = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 2
        t[begin[1:] - 1] = 1
        t = np.concatenate([t, np.zeros(1, np.uint16)])
        starts = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begin, sizes)])
        twice = repeated_windows(t, starts, length)
        found, where = [], np.searchsorted(starts, begin[:-1])
        for i in np.flatnonzero(n == 1):
            hit = np.flatnonzero(twice[where[i]:where[i] + sizes[i] - length + 1])
            if len(hit):
                gap = np.flatnonzero(np.diff(hit) > 1)
                found += [(i, hit[a], hit[b]) for a, b in zip([0, *(gap + 1)], [*gap, len(hit) - 1])]
        take = pa.array([f[0] for f in found], pa.int64())
        return pa.table({"anchor": table.column("anchor").take(take), "key": table.column("key").take(take),
                         "lo": pa.array([f[1] for f in found], pa.int64()), "hi": pa.array([f[2] for f in found], pa.int64())})

    parts = scratch.store(placed.groupBy("hot", "shard", "x", "y").applyInArrow(
        compare, "anchor bigint, key bigint, lo bigint, hi bigint"))
    some = several.join(parts.withColumnsRenamed({"lo": "a", "hi": "b"}), ["anchor", "key"]).select(
        "doc_id", "copy", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    copies = runs.join(classes.filter("n > 1").select("anchor", "key"), ["anchor", "key"]).select("doc_id", "copy", "lo", "hi")
    gone = copies.union(some).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))
    gone = gone.withColumnsRenamed(renamed)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, _ in pieces(batches, limit=PIECE):
            rows = []
            for value, own in zip(piece.column("text").to_pylist(), piece.column("gone").to_pylist()):
                data = bytes_of(value)
                left, at, removed, spans = [], 0, 0, 0
                end = -1
                for r in sorted(own or (), key=lambda r: r["lo"]):
                    lo, hi = r["lo"], r["hi"] + length
                    if lo > end:
                        left.append(data[at:lo])
                        spans += 1
                        removed += hi - lo
                    elif hi > end:
                        removed += hi - end
                    end = max(end, hi)
                    at = end
                left.append(data[at:])
                rest = b"".join(left)
                rows.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest if kept_bytes else None))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds))][:len(names)], names)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept_bytes else [])]
    return docs.join(gone, same_row(gone), "left").select("doc_id", "text", "gone").mapInArrow(
        finish, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
                + (", kept binary" if kept_bytes else ""))
