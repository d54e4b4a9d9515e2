"""Prefix trie of conversations: sorted shards of turn-id matrices, and their boundary nodes put together."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import Scratch

WIDTH = 16              # turns of a matrix block: padding is less than this a conversation
SHARD_TURNS = 2_000_000
IDS_PER_CHUNK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("node", pa.binary()),
    ("parent", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("bytes", pa.int64()),
    ("ends", pa.string())])
NODE_SQL = ("kind string, shard int, side int, depth long, node binary, parent binary, conv_id long, "
            "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string")


def head_turns(conv_id: Column) -> Column:
    """How many turns of the shared opening a rebuilt conversation begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): each conversation rebuilt, as two 64-bit hashes and the UTF-8 bytes of every turn.

    A conversation opens with the first h turns of conversation c - c % 5 and goes on with its own turns after its
    first h.  What is gathered is 24 bytes a turn, never a text.
    """
    speaker, body = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role, text))
    own = turns.filter(turns[id].isNotNull()).select(turns[id].cast("long").alias("conv_id"), F.struct(
        turns[turn].alias("turn"), F.xxhash64(speaker, body).alias("a"), F.xxhash64(F.lit(1), body, speaker).alias("b"),
        F.octet_length(body).cast("long").alias("n")).alias("t"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.select("conv_id", head_turns(F.col("conv_id")).alias("h"), F.transform(
        "turns", lambda t: F.struct(t["a"], t["b"], t["n"])).alias("turns"))
    opening = whole.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("opening"))
    joined = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(opening, "base", "left")
    none = F.array().cast(joined.schema["turns"].dataType)
    both = joined.select("conv_id", F.concat(
        F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))
    return both.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("ids"),
                       F.transform("turns", lambda t: t["n"]).alias("sizes"))


def sorted_rows(tid: np.ndarray, begin: np.ndarray, length: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows in order of their turn ids, a prefix before what it begins, then of their conversation.

    Matrix blocks from the last columns to the first, each a stable lexsort of the rows that reach it; a row joins in at
    its own last block, so the work grows with the turns and not with rows times the longest row.
    """
    last = (length - 1) // WIDTH                                                   # -1 for rows without turns
    waiting = np.lexsort((conv, last))
    bounds = np.searchsorted(last[waiting], np.arange(-1, int(last.max(initial=-1)) + 2))
    at = np.empty(0, np.int64)
    for k in range(len(bounds) - 3, -1, -1):
        at = np.concatenate([waiting[bounds[k + 1]:bounds[k + 2]], at])            # ends here: zeros in all later blocks
        m = block(tid, begin, length, at, k)
        at = at[np.lexsort(m.T[::-1])]
    return np.concatenate([waiting[:bounds[1]], at])


def block(tid: np.ndarray, begin: np.ndarray, length: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Columns k * WIDTH on of the padded matrix, for rows that reach them; 0 is padding."""
    column = k * WIDTH + np.arange(WIDTH)
    inside = column[None] < length[rows][:, None]
    at = np.where(inside, begin[rows][:, None] + column[None], 0)
    return np.where(inside, tid[at], 0)


def node_starts(tid: np.ndarray, begin: np.ndarray, length: np.ndarray, order: np.ndarray
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 1: the positions of the rows that long, and which of them start a node.

    A column changes where it differs from the row before; changes are OR-accumulated along the columns, and carried
    from block to block.
    """
    changed = np.zeros(len(order), bool)
    size = length[order]
    position = np.arange(len(order))
    k = 0
    while True:
        position = position[size[position] > k * WIDTH]
        if not len(position):
            return
        m = block(tid, begin, length, order[position], k)
        before = np.zeros_like(m)
        follows = np.flatnonzero(np.diff(position) == 1) + 1
        before[follows] = m[follows - 1]
        masks = m != before
        masks[:, 0] |= changed[position] | (position == 0)
        masks = np.logical_or.accumulate(masks, axis=1)
        changed[position] = masks[:, -1]
        for c in range(WIDTH):
            deep = m[:, c] > 0
            if not deep.any():
                return
            yield position[deep], masks[deep, c]
        k += 1


def shard_nodes(shard: int, conv: np.ndarray, length: np.ndarray, ids: np.ndarray, sizes: np.ndarray
                ) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard's conversations: finished ones, and those that hold its first or last row, which other shards
    may hold too ('open': the two boundary paths, each node's sums under the first path that has it; 'ends': their
    conversations' ids)."""
    n = len(conv)
    by_id = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[by_id][1:] != ids[by_id][:-1]).any(1)
    tid = np.empty(len(ids), np.int64)
    tid[by_id] = np.cumsum(new)                                                    # 1, 2, ...: 0 is padding
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    order = sorted_rows(tid, begin, length, conv)
    conv_at, size_at = conv[order], length[order]

    # One entry a depth: first position of each node, members, smallest member, bytes of the last turn, open sides.
    start, members, least, last_bytes = [np.zeros(1, np.int64)], [np.array([n])], [conv.min(keepdims=True)], [np.zeros(1, np.int64)]
    opened = [np.ones(1, bool)]
    ended = [np.array([int((size_at == 0).sum())])]
    for rows, first in node_starts(tid, begin, length, order):
        depth, at = len(start), np.flatnonzero(first)
        start.append(rows[at])
        members.append(np.diff(np.append(at, len(rows))))
        least.append(np.minimum.reduceat(conv_at[rows], at))
        last_bytes.append(sizes[begin[order[rows[at]]] + depth - 1])
        ended.append(np.add.reduceat((size_at[rows] == depth).astype(np.int64), at))
        open_here = np.zeros(len(at), bool)
        open_here[0] |= rows[0] == 0
        open_here[-1] |= rows[-1] == n - 1
        opened.append(open_here)

    deepest = len(start) - 1
    children, leaves, saved, parent = ([None] * (deepest + 1) for _ in range(4))
    for d in range(deepest, -1, -1):
        m = len(start[d])
        kids, below, spared = (np.zeros(m, np.int64) for _ in range(3))
        if d < deepest:
            parent[d + 1] = np.searchsorted(start[d], start[d + 1], "right") - 1
            at = np.flatnonzero(np.diff(parent[d + 1], prepend=-1))               # siblings stand together
            has = parent[d + 1][at]
            kids[has] = np.add.reduceat((~opened[d + 1]).astype(np.int64), at)
            below[has] = np.add.reduceat(leaves[d + 1], at)
            spared[has] = np.add.reduceat(saved[d + 1], at)
            childless = np.ones(m, bool)
            childless[has] = False
        else:
            childless = np.ones(m, bool)
        # What an open node itself adds is known only when all its parts are.
        below += ~opened[d] & childless
        spared += np.where(opened[d], 0, (members[d] - 1) * last_bytes[d])
        children[d], leaves[d], saved[d] = kids, below, spared

    # Boundary paths, with a digest that names a node in all shards.
    names, paths = [], []
    for row in (0, n - 1):
        digest, names_of = hashlib.md5(), []
        o = order[row]
        raw = np.ascontiguousarray(ids[begin[o]:begin[o] + length[o]])
        names_of.append(digest.digest())
        for d in range(len(raw)):
            digest.update(raw[d].tobytes())
            names_of.append(digest.digest())
        names.append(names_of)
        paths.append([int(np.searchsorted(start[d], row, "right") - 1) for d in range(len(raw) + 1)])

    def batch(kind: str, count: int, **columns) -> pa.RecordBatch:
        made = {"kind": pa.array([kind] * count), "shard": pa.array(np.full(count, shard, np.int32))}
        made |= {k: v if isinstance(v, pa.Array) else pa.array(v, NODE.field(k).type) for k, v in columns.items()}
        return pa.RecordBatch.from_arrays(
            [made.get(f.name, pa.nulls(count, f.type)) for f in NODE], schema=NODE)

    for side in (0, 1):
        out = []
        for d, (i, name) in enumerate(zip(paths[side], names[side])):
            again = side == 1 and d < len(paths[0]) and names[0][d] == name
            out.append((d, name, names[side][d - 1] if d else None, int(last_bytes[d][i])) + (
                (None, 0, 0, 0, 0) if again else (int(least[d][i]), int(members[d][i]), int(children[d][i]),
                                                   int(leaves[d][i]), int(saved[d][i]))))
            if ended[d][i] and not again:
                at = int(start[d][i])                                              # ends stand first in a node
                for low in range(at, at + int(ended[d][i]), IDS_PER_CHUNK):
                    some = conv_at[low:min(low + IDS_PER_CHUNK, at + int(ended[d][i]))]
                    yield batch("ends", 1, node=[name], conv_id=[int(some[0])], ends=[",".join(map(str, some.tolist()))])
        columns = dict(zip(("depth", "node", "parent", "bytes", "conv_id", "n_convs", "n_children", "n_leaves",
                            "saved_tokens"), map(list, zip(*out))))
        yield batch("open", len(out), side=[side] * len(out), **columns)

    for d in range(1, deepest + 1):
        for low in range(0, len(start[d]), 50_000):
            at = low + np.flatnonzero(~opened[d][low:low + 50_000])
            if not len(at):
                continue
            up = parent[d][at]
            ends = [NO_ENDS if not e else hashlib.sha256(
                ",".join(map(str, conv_at[s:s + e].tolist())).encode()).hexdigest()
                for s, e in zip(start[d][at].tolist(), ended[d][at].tolist())]
            # An open parent is named by its side: the last row's path holds it unless the first row's does.
            outer = opened[d - 1][up]
            side = np.where(up == (paths[0][d - 1] if d - 1 < len(paths[0]) else -1), 0, 1).astype(np.int32)
            yield batch("node", len(at), depth=np.full(len(at), d), conv_id=least[d][at],
                        parent_conv_id=pa.array(least[d - 1][up], mask=outer), side=pa.array(side, mask=~outer),
                        n_convs=members[d][at], n_children=children[d][at], n_leaves=leaves[d][at],
                        saved_tokens=saved[d][at], ends=ends)


def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, length, ids, sizes = [], [], [], []
    for batch in batches:
        conv.append(batch.column("conv_id").to_numpy())
        turns = batch.column("sizes")
        length.append(np.diff(turns.offsets.to_numpy()).astype(np.int64))
        sizes.append(turns.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        ids.append(batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2))
    if sum(map(len, conv)):
        yield from shard_nodes(TaskContext.get().partitionId(), *map(np.concatenate, (conv, length, ids, sizes)))


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's chunks of ids, which come in order: one running state, whatever the node's size."""
    node, state = None, None
    done = []
    for batch in batches:
        for name, part in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["node", "ends_sha256"])
            done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def conversation_trie(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      scratch: Scratch | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: members, children, leaves, bytes saved, ends.

    Conversations are dealt to shards by range of (turn ids, conv_id), so equal conversations may fill many shards. A
    shard sorts its padded turn-id matrix, marks node starts by accumulated column changes, and sums every depth with
    reduceat.  Nodes that hold neither the first nor the last row of a shard are finished there.  The others lie on two
    paths a shard: their parts are summed by the digest of their turns, their own shares are then added to all their
    ancestors along the paths, and their ends' ids run in order through one hash state.

    Turns come in order of `turn`, nulls first, equal ones by a hash of role and text; a null role or text is empty; a
    repeated row is a turn of its own.  Rows with a null id belong to no conversation and are left out.  A conversation
    left without turns is a member of the root alone.  An empty table gives no rows, not even a root.  A turn is known
    by 128 bits of its role and text.  One conversation (24 bytes a turn) has to fit a task; a group of equal ones need not.
    Other columns are not read.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    rows = scratch.store(rebuilt(turns, id, turn, role, text))
    total = rows.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TURNS))
    parts = scratch.store(rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(read_shard, NODE_SQL))
    path = parts.filter("kind = 'open'").select("shard", "side", "depth", "node", "parent", "conv_id", "n_convs",
                                                "n_children", "n_leaves", "saved_tokens", "bytes")
    whole = path.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.first("bytes").alias("bytes"),
        F.min(F.struct("shard", "side")).alias("on"))
    inner = whole.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("opened"))
    whole = scratch.store(whole.join(inner, "node", "left").withColumn(
        "n_children", F.col("closed") + F.coalesce("opened", F.lit(0))))
    # Each open node's own share is laid on one path, summed from the path's end up, and added over the paths.
    mine = (F.col("on.shard") == F.col("shard")) & (F.col("on.side") == F.col("side"))
    upward = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    shares = path.select("shard", "side", "depth", "node").join(
        whole.select("node", "on", "n_children", "n_convs", "bytes"), "node").select(
        "node", F.sum(F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).over(upward).alias("leaves_below"),
        F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)).over(upward).alias("saved_below"))
    shares = shares.groupBy("node").agg(F.sum("leaves_below").alias("leaves_below"), F.sum("saved_below").alias("saved_below"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = (parts.filter("kind = 'ends'").select("node", "conv_id", "ends").repartition(n, "node")
            .sortWithinPartitions("node", "conv_id").mapInArrow(hash_ends, "node binary, ends_sha256 string"))
    up = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    edge = (whole.join(shares, "node").join(ends, "node", "left").join(up, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.col("leaves_below")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    closed = parts.filter("kind = 'node'")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.col("ends").alias("ends_sha256"))
    within = closed.filter("side is null").select(*columns)
    # Parents by shard, side and depth: the root's children spread over the shards.
    above = path.select("shard", "side", (F.col("depth") + 1).alias("depth"), "node").join(
        whole.select("node", F.col("conv_id").alias("parent_conv_id")), "node").drop("node")
    beside = closed.filter("side is not null").drop("parent_conv_id").join(above, ["shard", "side", "depth"]).select(*columns)
    return edge.unionByName(within).unionByName(beside)


def oracle() -> str:
    """DuckDB SQL over `conversations`, prefixes as lists."""
    return """
with recursive bits(i, k, v) as (
    select i, 0, i from range(256) r(i)
    union all
    select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as tab from bits where k = 8),
own as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first) as turns
        from conversations where conv_id is not null group by 1),
h as (select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
          str_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
          lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h from own cross join crc),
r as (select h.conv_id, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) as turns
      from h left join own o on o.conv_id = h.conv_id - h.conv_id % 5),
p as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from r),
q as (select conv_id, depth, md5(turns[1:depth]::json::varchar) as node, depth = len(turns) as ends,
      case when depth = 0 then 0 else strlen(turns[depth].text) end as bytes,
      case when depth > 0 then md5(turns[1:depth - 1]::json::varchar) end as up from p),
n as (select depth, node, min(up) as up, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes,
      sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
      from q group by 1, 2),
k as (select up, depth - 1 as depth, count(*) as n_children from n where up is not null group by 1, 2),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.up = n.node and k.depth = n.depth),
below as (select a.depth, a.node, sum((m.n_children = 0)::int) as n_leaves, sum((m.n_convs - 1) * m.bytes) as saved_tokens
          from m join q b on b.conv_id = m.conv_id and b.depth = m.depth
          join q a on a.conv_id = m.conv_id and a.depth <= m.depth group by 1, 2)
select m.conv_id, m.depth::bigint as depth, u.conv_id as parent_conv_id, m.n_convs::bigint as n_convs,
       m.n_children::bigint as n_children, below.n_leaves::bigint as n_leaves,
       below.saved_tokens::bigint as saved_tokens, m.ends_sha256
from m join below on below.depth = m.depth and below.node = m.node
left join m u on u.node = m.up and u.depth = m.depth - 1"""
