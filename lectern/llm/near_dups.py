"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mix, pieces, shingles, words
from lectern.llm.components import components, find, hook

BANDS, WIDTH = 32, 4
SKETCH_BYTES = 4 << 20


def sketch(key: np.ndarray, row: np.ndarray, n_rows: int, bins: int = BANDS * WIDTH) -> np.ndarray:
    """Fast similarity sketches of sets given as (row, element hash): n_rows x bins.

    Round i throws every element into one of the bins with a value drawn for that round; a bin keeps the smallest
    (round, value).  After `bins` rounds, round bins + j puts all elements into bin j, so every bin of a non-empty set
    fills.  Sets leave as soon as their bins are full, mostly after one or two rounds.  Two sets agree in a bin with
    a probability equal to their Jaccard similarity, and the agreements concentrate.
    """
    empty = np.uint64((1 << 64) - 1)
    out = np.full((n_rows, bins), empty)
    flat = out.reshape(-1)
    for i in range(2 * bins):
        if not len(key):
            break
        drawn = mix(key + np.uint64(0x632BE59BD9B4E019 * (i + 1) % (1 << 64)))
        bin_ = (drawn % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(key), i - bins)
        value = (np.uint64(i) << np.uint64(48)) | (mix(drawn) >> np.uint64(16))
        np.minimum.at(flat, row * bins + bin_, value)
        going = (out == empty).any(1)
        stay = going[row]
        key, row = key[stay], row[stay]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of WIDTH coordinates."""
    made = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), BANDS)).copy()
    for k in range(WIDTH):
        made = mix(made * np.uint64(0x5851F42D4C957F2D) + sketches[:, k::WIDTH])
    return made.view(np.int64)


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    word, row, _, _ = words(data, offsets)
    return shingles(word, row, size, len(offsets) - 1)


def intersections(texts: pa.ChunkedArray, size: int, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the common sets of all pairs of some texts, and of the sets; shingles in one text only are left out."""
    keys, rows, done = [], [], 0
    for piece, data, offsets in pieces(iter(pa.table({"text": texts}).combine_chunks().to_batches()), limit=SKETCH_BYTES):
        key, row = sets_of(data, offsets, size)
        keys.append(key)
        rows.append(row + done)
        done += len(piece)
    row = np.concatenate(rows)
    _, code, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    n = np.bincount(row, minlength=done)
    many = times > 1
    code, row = (np.cumsum(many) - 1)[code[many[code]]], row[many[code]]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    common = np.zeros((done, done))
    for lo in range(0, int(many.sum()), columns):
        a, b = np.searchsorted(code, [lo, lo + columns])
        has = np.zeros((done, columns), np.float32)
        has[row[a:b], code[a:b] - lo] = 1
        common += has @ has.T
    return common, n


def near_documents(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80,
                   block_rows: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """Per row: its number of distinct shingles, component (smallest id reachable) and whether it is the one kept.

    Documents are linked if 100 * intersection >= `percent` * union of their sets of `size`-word shingles (shorter
    texts: all their words as one).  Equal sets form a class; one member of each goes on.  Sketches are banded; the
    members of a bucket are compared with its smallest member, and members that are then still in different components
    with each other, a pair in the first bucket it shares, in blocks of `block_rows`.  Every link is confirmed on the
    full sets of 64-bit shingle hashes; only links that span a component leave a block.

    A null or wordless text has an empty set and is its own component.  A row with a null id is no node: it takes the
    component of the class it copies, if that has an id.  Rows that repeat an id are judged by their own text.  An
    empty table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()
    docs = df.select(df[id].alias("doc_id"), df[text].alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in pieces(batches, limit=SKETCH_BYTES):
            n = len(offsets) - 1
            key, row = sets_of(data, offsets, size)
            bands = band_keys(sketch(key, row, n))
            sums = [np.zeros(n, np.uint64) for _ in range(2)]
            for k, s in enumerate(sums):
                np.add.at(s, row, mix(key + np.uint64(k + 1)))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.bincount(row, minlength=n), pa.int64()),
                 *(pa.array(s.view(np.int64)) for s in sums),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))],
                ["doc_id", "n", "s", "t", "bands"])

    marked = scratch.store(docs.mapInArrow(digest, f"doc_id {kind}, n bigint, s bigint, t bigint, bands array<bigint>"))
    same = ["n", "s", "t"]
    classes = scratch.store(marked.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")))
    reps = scratch.store(marked.join(classes.filter("rep is not null"), same).filter("doc_id = rep").select(
        "rep", *same, "bands").dropDuplicates(["rep", *same]))

    # members of buckets of two or more, with the bucket's smallest member, and the texts of all of them
    placed = reps.select("rep", *same, F.explode("bands").alias("key"))
    pivots = placed.groupBy("key").agg(F.min(F.struct("rep", *same)).alias("p"), F.count("*").alias("m")).filter("m > 1")
    buckets = scratch.store(placed.join(pivots, "key").filter(F.struct("rep", *same) != F.col("p")).select(
        "key", "rep", *same, F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")))
    members = buckets.select("rep").union(buckets.select("pivot")).distinct()
    texts = scratch.store(docs.join(members, docs.doc_id == members.rep).select("rep", "text").distinct())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in pieces(batches, "text_b", SKETCH_BYTES):
            n = len(offsets) - 1
            key, row = sets_of(data, offsets, size)
            own = 0
            for other, data_a, offsets_a in pieces(iter([piece]), "text_a", SKETCH_BYTES):
                m = len(offsets_a) - 1
                key_a, row_a = sets_of(data_a, offsets_a, size)
                part = (row >= own) & (row < own + m)
                key_b, row_b = key[part], row[part] - own
                both = np.isin(mix(key_b + row_b.astype(np.uint64)), mix(key_a + row_a.astype(np.uint64)))
                common = np.bincount(row_b[both], minlength=m)
                union = np.bincount(row_a, minlength=m) + np.bincount(row_b, minlength=m) - common
                yield other.select(["a", "b"]).filter(pa.array((100 * common >= percent * union) & (union > 0)))
                own += m

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are alike."""
        b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
        a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(
            confirm, f"a {kind}, b {kind}")

    def likely(a: str, b: str):
        return (100 * F.least(a, b) >= percent * F.greatest(a, b))

    tried = buckets.filter(likely("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    edges = scratch.store(links(tried))
    found = components(edges, scratch)

    # members that are still in different components of a bucket: compared in blocks of bounded size
    label = buckets.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("c"))
    apart = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter(
        "lo <> hi").select("key", F.ceil(F.col("m") / block_rows).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    left = label.join(apart, "key").withColumn("z", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "key", F.least(mine, "z").alias("x"), F.greatest(mine, "z").alias("y"), "rep", "c")
    loaded = left.join(reps.select("rep", "bands"), "rep").join(texts, "rep")

    def compare(table: pa.Table) -> pa.Table:
        names, code = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        first = np.unique(code, return_index=True)[1]      # a row twice in a block pair is taken once
        table = table.take(pa.array(first))
        root = np.arange(len(names))
        group = np.unique(table.column("c").to_numpy(), return_inverse=True)[1]
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        here = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
        earlier = np.zeros((len(names), len(names)), bool)
        for k in range(here):                              # such pairs are compared in the earlier band
            earlier |= bands[:, k][:, None] == bands[:, k][None, :]
        open_ = ~earlier & (group[:, None] < group[None, :])
        if open_.any():
            common, n = intersections(table.column("text"), size)
            union = n[:, None] + n[None, :] - common
            hook(root, *np.nonzero(open_ & (100 * common >= percent * union)))
            root = find(root, np.arange(len(root)))
        tied = np.flatnonzero(root != np.arange(len(root)))
        type_ = table.schema.field("rep").type
        return pa.table({"a": pa.array(names[root[tied]].tolist(), type_), "b": pa.array(names[tied].tolist(), type_)})

    more = scratch.store(loaded.groupBy("key", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}"))
    if not more.isEmpty():
        found = components(edges.union(more), scratch)

    whole = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        *same, F.coalesce("component", "rep").alias("component"))
    return marked.select("doc_id", *same).join(whole, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
