"""Near-duplicate vectors: an exact metric range join over pivot cells."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch
from lectern.llm.components import components, find, hook

SLACK = 1e-6
ALL_PIVOTS = 65_536


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def near_vectors(df: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding",
                 label: str = "label", cell_rows: int = 2048, partner_rows: int = 8192, most_pivots: int = 256,
                 scratch: Scratch | None = None) -> DataFrame:
    """Per row: its links (other vectors of its label with cosine >= `least`), component, and whether it is kept.

    Equal unit vectors of a label are one class.  A label with more than `cell_rows` classes gets a pivot for each
    `cell_rows`, at most `most_pivots`, and all labels together at most ALL_PIVOTS (so what the tasks carry is bounded).
    A class belongs to its nearest pivot's cell; a copy goes to each cell whose boundary the range may cross, by the
    triangle inequality on angles: distance to that cell's pivot less distance to its own is at most twice the range,
    and at most the cell's radius plus the range from that pivot.  A cell compares its own classes with them and the
    copies, in blocks of bounded size, in double precision; only counts and a spanning edge for each class leave it.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers, and rows with a null label, link with
    nothing, as do rows with a null id (their component is null, they are kept).  Vectors of different length do not
    link.  Rows that repeat an id are judged by their own vector, and count as vectors; classes with the same smallest id
    are one node.  An empty table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(df[id].alias("vec_id"), df[label].cast("string").alias("label"),
                     df[vector].cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for v, l in zip(b.column("v").to_pylist(), b.column("label").to_pylist()):
                x = np.array(v if v and None not in v else [np.nan], float)
                top = np.abs(x).max()
                if l is None or not np.isfinite(top) or top == 0:
                    made.append(None)
                    continue
                x = x / top
                made.append((x / np.sqrt(x @ x) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(made, pa.binary())],
                                             ["vec_id", "label", "v"])

    units = scratch.store(rows.mapInArrow(unit, f"vec_id {kind}, label string, v binary"))
    part = ["label", "dim"]
    equal = scratch.store(units.filter("v is not null and vec_id is not null").withColumn("dim", F.length("v")).groupBy(
        *part, "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    total = equal.count()
    sizes = equal.groupBy(*part).agg(F.count("*").alias("size"))
    pivots_of = F.least(F.lit(most_pivots), F.ceil(F.col("size") / cell_rows),
                        F.floor(F.col("size") * ALL_PIVOTS / max(total, 1)))
    classes = scratch.store(equal.join(sizes, part).withColumn("k", pivots_of.cast("int")).withColumn(
        "spot", F.xxhash64("rep")))
    draw = F.xxhash64("v", F.lit(11)).bitwiseAND((1 << 40) - 1)
    drawn = classes.filter("k > 1").filter(draw / float(1 << 40) <= (2 * F.col("k") + 8) / F.col("size"))
    taken: dict[tuple[str, int], list[bytes]] = {}
    for r in drawn.select(*part, "v", "k", draw.alias("d")).orderBy(*part, "d").toLocalIterator():
        own = taken.setdefault((r["label"], r["dim"]), [])
        if len(own) < r["k"]:
            own.append(bytes(r["v"]))
    pivots = {key: np.frombuffer(b"".join(own), np.float64).reshape(len(own), -1) for key, own in taken.items()}
    reach = float(np.arccos(least)) + SLACK

    def by_label(batches: Iterator[pa.RecordBatch]):
        """(label, dim), rows, angles to the label's pivots, own cell."""
        for batch in batches:
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                b = batch.take(pa.array(at))
                p = pivots.get(key)
                a = np.zeros((len(b), 1)) if p is None else np.arccos(np.clip(matrix(b.column("v")) @ p.T, -1, 1))
                yield key, b, a, a.argmin(1)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[tuple[str, int, int], float] = {}
        for (l, d), b, a, cell in by_label(batches):
            for c in np.unique(cell).tolist():
                far[l, d, c] = max(far.get((l, d, c), 0.0), float(a[cell == c, c].max()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            [*map(list, zip(*far)), list(far.values())] if far else [[]] * 4,
            (pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["label", "dim", "cell", "far"])

    cells = ["label", "dim", "cell"]
    pivoted = classes.filter("k > 1").select(*part, "v")
    radius = {tuple(r[c] for c in cells): r["far"] for r in pivoted.mapInArrow(
        radii, "label string, dim int, cell int, far double").groupBy(*cells).agg(F.max("far").alias("far")).collect()}

    def inside(key: tuple[str, int], c: int, a: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which rows cell c needs: its own, and those within reach of its boundary and of its ball."""
        mine = a[np.arange(len(a)), cell]
        return (cell == c) | ((a[:, c] - mine <= 2 * reach) & (a[:, c] <= radius[(*key, c)] + reach))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], list[int]] = {}
        for key, b, a, cell in by_label(batches):
            for c in range(a.shape[1]):
                if (*key, c) in radius:
                    s = seen.setdefault((*key, c), [0, 0])
                    s[0] += int((cell == c).sum())
                    s[1] += int(inside(key, c, a, cell).sum())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            [*map(list, zip(*seen)), *map(list, zip(*seen.values()))] if seen else [[]] * 5,
            (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["label", "dim", "cell", "own", "near"])

    blocks = {tuple(r[c] for c in cells): (-(-r["own"] // cell_rows), -(-r["near"] // partner_rows))
              for r in pivoted.mapInArrow(count, "label string, dim int, cell int, own bigint, near bigint").groupBy(
                  *cells).agg(F.sum("own").alias("own"), F.sum("near").alias("near")).collect()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class as a row of its cell (own) for every block of partners, and as a partner for every block of rows."""
        for key, b, a, cell in by_label(batches):
            spot = b.column("spot").to_numpy().astype(np.uint64)
            for c in range(a.shape[1]):
                if key in pivots:
                    if (*key, c) not in blocks:
                        continue
                    (nx, ny), at = blocks[(*key, c)], np.flatnonzero(inside(key, c, a, cell))
                else:
                    size = b.column("size")[0].as_py()
                    nx, ny, at = -(-size // cell_rows), -(-size // partner_rows), np.arange(len(b))
                for own, some in ((True, at[cell[at] == c]), (False, at)):
                    t = pa.array(some)
                    block = ((spot[some] >> np.uint64(20)) % np.uint64(nx if own else ny)).astype(np.int32)
                    cols = [b.column(n).take(t) for n in ("label", "dim", "rep", "n", "v")]
                    for other in range((ny if own else nx) if len(some) else 0):
                        same = np.full(len(some), other, np.int32)
                        x, y = (block, same) if own else (same, block)
                        yield pa.RecordBatch.from_arrays(
                            [*cols, pa.array(np.full(len(some), c, np.int32)), pa.array(x), pa.array(y),
                             pa.array(np.full(len(some), own))],
                            ["label", "dim", "rep", "n", "v", "cell", "x", "y", "own"])

    sent = classes.mapInArrow(send, f"label string, dim int, rep {kind}, n bigint, v binary, cell int, x int, y int, "
                                    "own boolean")

    def compare(table: pa.Table) -> pa.Table:
        names, code = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        own = table.column("own").to_numpy().astype(bool)
        x, times = matrix(table.column("v")), table.column("n").to_numpy().astype(float)
        rows, partners = np.flatnonzero(own), np.flatnonzero(~own)
        links, root, others = np.zeros(len(rows)), np.arange(len(names)), x[partners].T
        for lo in range(0, len(rows), 256):
            some = rows[lo:lo + 256]
            near = (x[some] @ others >= least) & (code[some][:, None] != code[partners][None, :])
            if near.any():
                links[lo:lo + 256] = near.astype(float) @ times[partners]
                i, j = np.nonzero(near)
                hook(root, code[some[i]], code[partners[j]])
        root = find(root, np.arange(len(root)))
        tied = np.flatnonzero(root != np.arange(len(root)))
        kept = np.flatnonzero(links > 0)
        type_ = table.schema.field("rep").type
        return pa.table({
            "rep": pa.array([*names[code[rows[kept]]].tolist(), *names[tied].tolist()], type_),
            "n": pa.array(np.concatenate([links[kept], np.zeros(len(tied))]).astype(np.int64)),
            "b": pa.array([None] * len(kept) + names[root[tied]].tolist(), type_)})

    found = scratch.store(sent.groupBy(*cells, "x", "y").applyInArrow(compare, f"rep {kind}, n bigint, b {kind}"))
    links = found.groupBy("rep").agg(F.sum("n").alias("links"))
    whole = components(found.filter("b is not null").select(F.col("rep").alias("a"), "b"), scratch)
    judged = classes.join(links, "rep", "left").join(whole, F.col("rep") == F.col("node"), "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    linked = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    return units.join(judged, ["label", "v"], "left").select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
